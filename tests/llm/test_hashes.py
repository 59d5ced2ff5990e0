"""Texts whose polynomial hashes modulo 2^64 are equal whatever the base, and spans at their edges."""

import numpy as np

from folioforge.llm import common, lm, paritysketch, rlz, suffixes

DOCS = "doc_id long, text string"


def pattern(n, a="j", b="0"):
    """Thue-Morse pattern of n letters and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_seeds_of_patterns_differ(spark):
    for n in (512, 1024, 8192):
        a, b = pattern(n)
        lead = " ".join(f"w{i}" for i in range(12))
        got = rlz.dedup(spark.createDataFrame([(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, f"{lead} {a}")], DOCS)).collect()
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def test_sets_of_patterns_differ(spark):
    a, b = pattern(1024)
    got = paritysketch.components(spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{b} x")], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2}


def test_words_of_patterns_are_counted_apart(spark):
    a, b = pattern(1024)
    score = lambda *texts: {r.doc_id: r.log_score for r in lm.score(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert score(f"x {a} y", f"x {b} y", f"x {a} z") == score("x first y", "x second y", "x first z")


def test_strings_of_patterns_are_no_repeats(spark):
    t, u = pattern(256)
    rnd = np.random.default_rng(5)
    left, right, gram = ("".join(rnd.choice(list("abcdefgh"), k)) for k in (80, 80, 64))
    rows = [(1, left + t + gram + u + right), (2, left + u + gram + t + right)]
    assert all(not r.n_removed for r in suffixes.dedup(spark.createDataFrame(rows, DOCS)).collect())


def test_hashes_follow_the_bytes():
    rnd = np.random.default_rng(1)
    buf = rnd.integers(0, 3, 6000).astype(np.uint8)
    s = rnd.integers(0, 6000, 4000)
    e = np.minimum(s + rnd.integers(0, 20, 4000), 6000)
    s, e = np.append(s, [0, 0, 5]), np.append(e, [6000, 4097, 5])
    keys = [buf[i:j].tobytes() for i, j in zip(s, e, strict=True)]
    assert len(set(zip(keys, common.span_hash(buf, s, e).tolist(), strict=True))) == len(set(keys)) == len(set(common.span_hash(buf, s, e).tolist()))
    for width in (8, 9, 13, 16, 40, 400):
        keys = [buf[i : i + width].tobytes() for i in range(6000 - width + 1)]
        h = common.window_hash(buf, width).tolist()
        assert len(h) == len(keys) and len(set(zip(keys, h, strict=True))) == len(set(keys)) == len(set(h))
