"""Jaccard components against brute force."""

import random
import re

import numpy as np

from folioforge.llm import paritysketch


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(a), least[find(i)]) for i, (d, a) in enumerate(sets))


def edited(rnd, words, share):
    return " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(9999)) if rnd.random() < share else w for w in words)


def test_components_are_brute_force(spark, docs_rows):
    rnd = random.Random(11)
    rows = list(docs_rows)
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([4, 6, 9, 20, 60, 150, 400]))]
        for c in range(rnd.choice([1, 2, 3, 5])):
            rows.append((1000 + 10 * k + c, edited(rnd, words, rnd.choice([0, 0.005, 0.02, 0.03, 0.05])).upper() if c % 2 else edited(rnd, words, 0.02), "en", "s", 1))
    family = [f"f{rnd.randrange(9000)}" for _ in range(160)]
    rows += [(5000 + i, edited(rnd, family, 0.012), "en", "s", 1) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(tuple(r) for r in paritysketch.components(df).collect())
    want = brute(rows)
    assert got == want
    assert sum(1 for d, _, c in want if d != c) > 60


def test_star_family_is_brute_force(spark):
    """2000 variants, each linked with the base alone: a crowded key's least class and
    neighbours in an order are nearly always other variants."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(304)]
    rows, places = [(0, " ".join(base))], set()
    while len(places) < 2000:
        places.add(tuple(sorted(rnd.sample(range(5, 300, 5), 6))))
    for i, at in enumerate(sorted(places), 1):
        words = list(base)
        for k in at:
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    column = {s: k for k, s in enumerate(sets[0])}
    has = np.zeros((len(sets), len(column)), np.int64)
    for i, s in enumerate(sets):
        has[i, [column[x] for x in s & sets[0]]] = 1  # variants share what the base has
    common, size = has @ has.T, np.array([len(s) for s in sets])
    linked = 100 * common >= 80 * (size[:, None] + size - common)
    assert linked[0].all() and linked[1:, 1:].sum() == 2000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = paritysketch.components(df).collect()
    assert len(got) == 2001 and {r.component_id for r in got} == {0}


def test_families_with_few_links_are_brute_force(spark):
    """Ten families of 402 texts that share most pieces but are linked in a few pairs only."""
    rnd, rows, want = random.Random(17), [], {}
    for f in range(10):
        base, texts = [f"f{f}w{i}" for i in range(300)], []
        for k in range(402):
            words = list(base)
            for i in rnd.sample(range(300), 3 if k in (100, 300) else 6):
                words[i] = f"f{f}k{k}i{i}"
            texts.append(" ".join(words))
        column = {x: i for i, x in enumerate(sorted(set().union(*map(shingles, texts))))}
        has = np.zeros((402, len(column)), np.float32)
        for k, t in enumerate(texts):
            has[k, [column[x] for x in shingles(t)]] = 1
        common, size = (has @ has.T).astype(int), has.sum(1).astype(int)
        links = 100 * common >= 80 * (size[:, None] + size - common)
        root = list(range(402))
        for i, j in zip(*np.nonzero(links), strict=True):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        rows += [(1000 * f + k, t) for k, t in enumerate(texts)]
        want |= {1000 * f + k: 1000 * f + r for k, r in enumerate(root)}
    got = {r.doc_id: r.component_id for r in paritysketch.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want
    assert sum(a != b for a, b in want.items()) >= 10


def test_hollow_sets_share_a_key():
    """Sets with more empty pieces than the slack, elements crowded into few pieces."""
    rng = np.random.default_rng(4)
    bands = paritysketch.Bands(4000, 80, 100)
    for size in (40, 300, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**58, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: -(size // 20)], rng.integers(0, 2**64, size // 20, dtype=np.uint64)]))
            assert len(np.intersect1d(paritysketch.piece_keys(a, bands), paritysketch.piece_keys(b, bands)))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[100:], rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    c = np.unique(np.concatenate([a, rng.integers(0, 2**64, 200, dtype=np.uint64)]))
    x, y, z = paritysketch.sketches(np.concatenate([a, b, c]), np.cumsum([0, len(a), len(b), len(c)]))
    assert len(x) == len(y) == 256 and len(z) == 512
    near = int(np.bitwise_count(paritysketch.words_of([x]) ^ paritysketch.words_of([y])).sum())
    assert 130 < near <= 160
    far = int(np.bitwise_count(paritysketch.words_of([x]) ^ paritysketch.folds(paritysketch.words_of([z]), 32)).sum())
    assert 170 < far <= 200


def test_hot_pieces_keep_their_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    family = [f"f{rnd.randrange(9000)}" for _ in range(120)]
    rows = [(i, edited(rnd, family, 0.02), "en", "s", 1) for i in range(300)]
    monkeypatch.setattr(paritysketch, "HOT", 4)
    got = sorted(tuple(r) for r in paritysketch.components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)).collect())
    assert got == brute(rows)


def test_a_class_brings_two_ties_of_its_hot_keys(spark, monkeypatch):
    """Of all its hot keys together, and no link is lost by that."""
    rnd, ties, plausible = random.Random(9), [], paritysketch.plausible
    families = [[f"f{k}w{rnd.randrange(9000)}" for _ in range(120)] for k in range(2)]
    rows = [(i, edited(rnd, families[i % 2], 0.01 + 0.03 * (i % 2)), "en", "s", 1) for i in range(300)]
    monkeypatch.setattr(paritysketch, "HOT", 1)
    monkeypatch.setattr(paritysketch, "plausible", lambda pairs, *a: ties.extend(pairs.groupBy("b").count().collect()) or plausible(pairs, *a))
    got = sorted(tuple(r) for r in paritysketch.components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)).collect())
    assert got == brute(rows)
    assert len(ties) > 100 and max(r["count"] for r in ties) <= 2


def test_crowded_pairs_meet_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(paritysketch, "CROWD", 7)
    crowd = spark.createDataFrame([(1, c) for c in range(1, 41)] + [(2, c) for c in range(30, 50)] + [(3, c) for c in range(60, 80)], "key long, class long")
    words = lambda c: [c % 5 * 7] * 4 + [0] * (4 * (c % 3 == 0))  # noqa: E731  the longer ones fold to the same
    classes = spark.createDataFrame([(c, 100 + c % 3 * 20, bytearray(np.array(words(c), "<u8").tobytes())) for c in range(1, 90)], "class long, n long, sketch binary")
    root = lambda c: 60 if 60 <= c < 80 else c - c % 2 or c
    roots = spark.createDataFrame([(c, root(c)) for c in range(1, 90) if c % 10], "class long, root long")
    got = {tuple(r) for r in paritysketch.crowded_pairs(crowd, classes, roots, 80, 100).collect()}
    key, want = [set(range(1, 41)), set(range(30, 50)), set(range(60, 80))], set()
    for a in range(1, 90):
        for b in range(a + 1, 90):
            ra, rb = (root(x) if x % 10 else x for x in (a, b))
            na, nb = (100 + x % 3 * 20 for x in (a, b))
            d = 4 * bin(a % 5 * 7 ^ b % 5 * 7).count("1")
            if any(a in k and b in k for k in key) and ra != rb and 100 * min(na, nb) >= 80 * max(na, nb) and 180 * d <= 20 * (na + nb):
                want.add((a, b))
    assert got == want and len(want) > 300


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    bands = paritysketch.Bands(4000, 80, 100)
    for size in [*range(1, 60), 90, 100, 130, 200, 333, 500, 1000, 2500]:
        for _ in range(15):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = rng.integers(0, size // 9 + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, rng.integers(0, size // 4 + 1), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                assert len(np.intersect1d(paritysketch.piece_keys(a, bands), paritysketch.piece_keys(b, bands)))


def test_odd_inputs(odd_docs, no_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in paritysketch.components(odd_docs).collect())
    assert got == [(False, 7, 2, 7), (False, 7, 2, 7), (False, 8, 0, 8), (False, 9, 1, 9), (True, 0, 0, None), (True, 0, 1, None)]
    assert paritysketch.components(no_docs).count() == 0
