"""Word-seed dedup and vector search against brute force."""

import random

import numpy as np
import pytest

from folioforge.llm import rlz, topk


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_rlz(rows, window=13):
    first = {}
    for i, t in ((r[0], r[1]) for r in rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in ((r[0], r[1]) for r in rows):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_rlz_is_brute_force(docs, docs_rows):
    got = rlz.dedup(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_rlz(docs_rows)
    assert sum(1 for r in got if r.n_removed) > 5


@pytest.mark.parametrize("block", [300, 2 << 20])
def test_factors_are_substrings_of_their_reference(spark, docs_rows, monkeypatch, block):
    """Small blocks make documents meet in index blocks only, one large block by itself."""
    monkeypatch.setattr(rlz, "BLOCK", block)
    rows = list({r[0]: r for r in docs_rows}.values())
    texts = {r[0]: words(r[1]) for r in rows}
    got = rlz.dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_rlz(rows)
    longest = 0
    for r in got:
        for f, after in zip(r.factors, [*r.factors[1:], None], strict=False):
            n = f.past - f.first
            assert n >= 13 and f.ref < r.doc_id
            assert texts[r.doc_id][f.first : f.past] == texts[f.ref][f.ref_first : f.ref_first + n]
            assert after is None or after.first > f.first and after.past > f.past
            longest = max(longest, n)
    assert longest > 60


def test_rlz_odd_inputs(odd_docs, no_docs):
    got = rlz.dedup(odd_docs).collect()
    assert len(got) == 6 and all(r.n_removed == 0 for r in got)
    assert rlz.dedup(no_docs).count() == 0


def brute_topk(vectors, k=5):
    import math as m

    good = {i: [m.floor(256 * float(x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and m.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_topk_is_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    vectors = [(i, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(24)]) for i in range(400)]
    vectors += [(1000 + i, vectors[i % 7][1]) for i in range(120)]
    vectors += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 24), (2150, [float("inf")] * 24), (None, [0.1] * 24), (2200, []), (2250, [0.5] * 3)]
    monkeypatch.setattr(topk, "CANDIDATES", 150)
    monkeypatch.setattr(topk, "QUERIES", 4)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk.search(spark, df, lambda v: v % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(vectors)
    assert topk.search(spark, df.where("false"), lambda v: v % 50 == 0).count() == 0


def test_topk_repeated_ids_and_clashing_columns(spark):
    vectors = [(0, [0.5, 0.25], "x", 9), (0, [0.5, 0.25], "y", 8), (1, [1.0, 0.0], "x", 7), (1, [1.0, 0.0], "x", 7), (50, [0.25, 0.5], None, None), (2, [0.5, 0.25], "v", 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, v string, rank int").selectExpr("*", "1 AS qb", "2 AS asks")
    good = [(r[0], [int(256 * x) for x in r[1]]) for r in [*vectors, (1, [5.0, 0.0])]]
    df = df.unionByName(spark.createDataFrame([(1, [5.0, 0.0])], "vec_id long, embedding array<float>"), allowMissingColumns=True)
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for i, x in good if i == q for c, y in good if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.search(spark, df, lambda v: v % 50 == 0).collect()) == want


def test_topk_of_mixed_widths_is_brute_force(spark):
    rnd = random.Random(8)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(rnd.choice([1, 3, 17, 40]))]) for i in range(120)] + [(500, [0.5] * 70_000)]
    got = topk.search(spark, spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_topk(vectors)


def test_topk_of_large_components_is_brute_force(spark, monkeypatch):
    """Scores over 2^52, with norms far above the k-th score."""
    rnd = random.Random(12)
    vectors = [(i, [float(rnd.choice([-1, 1]) * rnd.randrange(1 << 18)) for _ in range(20)]) for i in range(160)]
    vectors += [(300 + i, [x + rnd.choice([0.0, 1 / 256]) for x in vectors[i][1]]) for i in range(40)]
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    got = topk.search(spark, spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), lambda v: v % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_topk(vectors)
    assert max(r.score for r in got) > 2**52


def test_packed_components_keep_their_values():
    for x in ([], [0, -5, 32767], [-32768, 3], [32768], [2**31, -1], [-(2**62), 2**62]):
        v = topk.packed(np.array(x, np.int64))
        assert np.frombuffer(v, topk.WIDTHS[v[0]], offset=1).tolist() == x
