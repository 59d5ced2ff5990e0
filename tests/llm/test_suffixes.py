"""Suffix-array dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import suffixes


def covered_bytes(rows, length):
    """(id, bytes, flags of the covered ones) of each row."""
    seen = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((i, t, gone))
    return out


def brute(rows, length):
    out = []
    for i, t, gone in covered_bytes(rows, length):
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def kept_characters(rows, length):
    """What stays if only characters go that are covered whole."""
    out = []
    for i, t, gone in covered_bytes(rows, length):
        at, kept = 0, []
        for c in t.decode():
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("most", [1024, 1])
def test_dedup_is_brute_force(docs, docs_rows, most):
    want = brute(docs_rows, 120)
    assert sum(1 for w in want if 0 < w[2] < w[1]) > 10
    assert result(suffixes.dedup(docs, 120, 16, most)) == want


def test_dedup_small_alphabet(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab") if rnd.random() < 0.05 else "a" for _ in range(rnd.randint(0, 600)))) for i in range(40)]
    rows += [(100 + i, rows[i][1][7:300] + "é" * 90 + rows[i + 1][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffixes.dedup(df, 100, 20)) == brute(rows, 100)


def test_cover_ranks_order_suffixes():
    x = np.frombuffer(random.Random(1).randbytes(64 * 20) * 2 + bytes(500), np.uint8) % 2
    rank = suffixes.cover_ranks(x.astype(np.uint8), 96)
    raw = x.astype(np.uint8).tobytes()
    places = range(0, len(x) - 96, suffixes.V)
    for i in places:
        for j in places:
            a, b = raw[i : i + 96], raw[j : j + 96]
            assert (rank[i // 32] < rank[j // 32]) == (a < b) and (rank[i // 32] == rank[j // 32]) == (a == b)


def test_odd_inputs(odd_docs, no_docs):
    got = suffixes.dedup(odd_docs).collect()
    assert len(got) == 6 and sum(r.n_removed for r in got) == 2 * len("x y " * 40000)
    assert suffixes.dedup(no_docs).count() == 0


def test_whole_characters():
    part = np.frombuffer("aéé".encode(), np.uint8)
    assert [x.tolist() for x in suffixes.whole_characters(part, np.array([2]), np.array([4]))] == [[], []]


def test_real_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffixes.dedup(df)) == brute(rows, 400)
