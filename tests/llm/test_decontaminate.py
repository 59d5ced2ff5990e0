"""Decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from folioforge.llm import decontaminate


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            k = min(10, len(w))
            windows += [(str(i), tuple(w[x : x + k])) for x in range(len(w) - k + 1)]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rnd = random.Random(4)
    vocabulary = ["the", "of", "a", "É", *(f"w{i}" for i in range(60))]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    items = [(i, text(rnd.choice([12, 25, 40]))) for i in range(12)] + [(90, "the"), (91, "Of the-of, the"), (92, None), (93, "!!"), (None, "x y"), (94, "the " * 15)]
    items += [(1, items[1][1]), (10, items[2][1])]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 80))
        if i % 3 == 0:
            w = rnd.choice(items[:12])[1].split()
            a = rnd.randint(0, 5)
            t += ", " + "; ".join(w[a : a + rnd.randint(5, 30)]).upper() + ". " + text(5)
        if i % 10 == 0:
            t += " the" * 30
        docs.append((i, t))
    docs += [(70, None), (71, ""), (72, "The"), (73, docs[0][1]), (73, docs[0][1]), (None, docs[3][1])]
    return docs, items


def test_scan_is_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS item", "1 AS pos")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS term")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in decontaminate.scan(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    assert decontaminate.scan(d.where("false"), b).count() == 0
    assert all(not r.contaminated for r in decontaminate.scan(d, b.where("false")).collect())


def near(docs, items, slack, missing):
    """(doc, sorted items) by the definition, window by window."""
    cf = Counter(w for _, t in docs for w in words(t))
    out = []
    for d, t in docs:
        w, ids = words(t), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for i, text in {(i, tuple(words(t))) for i, t in items if i is not None}:
            need = min(10, len(text))
            spare = min(missing, need // 5)
            for ws in range(len(text) - need + 1 if text else 0):
                places = sorted(range(ws, ws + need), key=lambda k: (cf[text[k]], k))[: spare + 1]
                for k in places:
                    for p in at.get(text[k], []):
                        if sum(any(abs(q - (p + j - k)) <= slack for q in at.get(text[j], [])) for j in range(ws, ws + need)) >= need - spare:
                            ids.add(str(i))
        out.append((d, sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("slack", "missing"), [(3, 1), (1, 0), (2, 2)])
def test_proximity_is_brute_force(spark, slack, missing):
    docs, items = case()
    rnd = random.Random(6)
    for k, (i, t) in enumerate(x for x in items[:12] for _ in range(3)):
        w = [f"r{i}x{j}" if j % 4 == 0 else x for j, x in enumerate(words(t))]
        items.append((200 + k, " ".join(w)))
        for _ in range(rnd.randint(0, 3)):
            w.insert(rnd.randrange(len(w)), "inserted")
        if k % 2:
            w[rnd.randrange(len(w))] = "changed"
        if k % 5 == 0:
            w[3:6] = w[5:2:-1]
        docs.append((300 + k, "before " + " ".join(w) + " after"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.near_ids) for r in decontaminate.scan(d, b, slack=slack, missing=missing).collect()), key=str)
    want = near(docs, items, slack, missing)
    assert got == want and sum(len(x) for _, x in want) > 40


def test_proximity_bears_inserted_and_changed_words(spark):
    item = " ".join(f"term{i}" for i in range(12))
    changed = item.replace("term2 ", "term2 put ").replace("term7 ", "term7 in ").replace("term5 ", "else ")
    d = spark.createDataFrame([(1, f"before {changed} after"), (2, "term0 nothing else term11"), (3, changed.replace("else", "term5"))], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id: r.near_ids for r in decontaminate.scan(d, b).collect()} == {1: [], 2: [], 3: ["5"]}
    got = {r.doc_id: r for r in decontaminate.scan(d, b, missing=1).collect()}
    assert (got[1].near_ids, got[1].n_near, got[1].contaminated) == (["5"], 1, False) and got[2].n_near == 0
