"""LM scores against brute force, a row a document of its own."""

import math
import random
import re
from collections import Counter

from folioforge.llm import lm


def brute(rows):
    parts = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        s = [None, *w] if w else []
        own = Counter(), Counter(), Counter()
        for n in (1, 2, 3):
            own[n - 1].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
        parts.append((d, w, own))
    f = [sum((p[2][n] for p in parts), Counter()) for n in range(3)]
    total, out = sum(n for (w,), n in f[0].items() if w is not None), []
    for d, w, own in parts:
        left = lambda *g, own=own: f[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i, c in enumerate(w):
            b = w[i - 1] if i else None
            s = math.log(left(b, c) / left(b)) if left(b, c) else math.log(0.4 * f[0][c,] / total)
            if i:
                a = w[i - 2] if i > 1 else None
                s = math.log(left(a, b, c) / left(a, b)) if left(a, b, c) else math.log(0.4) + s
            score += s
        out.append((d, len(w), score))
    return out


def order(x):
    return (x[0] is None, x[0] or 0, x[1], x[2])


def test_scores_are_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    text = lambda k: " ".join(f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(k))
    rows = [(i % 90, text(rnd.choice([0, 1, 5, 80, 400]))) for i in range(100)] + [(200, None), (None, text(9)), (None, " ")]
    monkeypatch.setattr(lm, "BLOCK", 9000)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=order)
    want = sorted(brute(rows), key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 1e-4 for x, y in zip(got, want, strict=True))  # rounded to 4 digits


def test_made_documents_are_brute_force(spark, docs, docs_rows):
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in lm.score(spark, docs).collect()), key=order)
    want = sorted(brute([r[:2] for r in docs_rows]), key=order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(x[2] - y[2]) < 1e-4 for x, y in zip(got, want, strict=True))


def test_odd_inputs(spark, odd_docs, no_docs):
    got = lm.score(spark, odd_docs).collect()
    assert len(got) == 6
    assert {(r.n_words, r.log_score) for r in got if r.doc_id == 8} == {(0, 0.0)} and [r.n_words for r in got if r.doc_id == 7] == [80000] * 2
    assert lm.score(spark, no_docs).count() == 0
