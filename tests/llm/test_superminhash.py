"""SuperMinHash groups against brute force, and its signatures against a plain loop."""

import random
import re

import numpy as np

from folioforge.llm import superminhash as s
from folioforge.llm.common import mix

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


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
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(a), least[find(i)], d == least[find(i)]) for i, (d, a) in enumerate(sets))


def edited(rnd, words, share):
    return " ".join(f"e{rnd.randrange(9999)}" if rnd.random() < share else w for w in words)


def test_groups_are_brute_force(spark, docs_rows):
    rnd = random.Random(17)
    rows = list(docs_rows)
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 7, 8, 9, 20, 60, 150, 400]))]
        for c in range(rnd.choice([1, 2, 3, 5])):
            t = edited(rnd, words, rnd.choice([0, 0.01, 0.03, 0.05])) + rnd.choice(["", " more"])
            rows.append((1000 + 10 * k + c, t.upper() if c % 2 else t, "en", "s", 1))
    family = [f"f{rnd.randrange(9000)}" for _ in range(160)]
    rows += [(5000 + i, edited(rnd, family, 0.015), "en", "s", 1) for i in range(80)]
    got = sorted(tuple(r) for r in s.groups(spark.createDataFrame(rows, DDL).repartition(5)).collect())
    want = brute(rows)
    assert got == want
    assert sum(1 for r in want if not r[3]) > 60


def test_signatures_are_the_sequential_ones():
    rnd = np.random.default_rng(3)
    sets = [rnd.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 60, 900)]
    got = s.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]), 32)
    for row, elements in zip(got, sets, strict=True):
        best = [32 << 32] * 32
        for e in elements:
            deal = list(range(32))
            for j in range(32):
                x = int(mix(np.array([e]) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
                k = j + ((x & 0xFFFFFFFF) * (32 - j) >> 32)
                deal[j], deal[k] = deal[k], deal[j]
                best[deal[j]] = min(best[deal[j]], (j << 32) + (x >> 32))
        assert row.tolist() == best


def test_large_sets_pass_from_chunk_to_chunk(monkeypatch):
    h = np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64)
    at = np.array([0, 5, 2500, 3000])
    whole = s.signatures(h, at)
    monkeypatch.setattr(s, "CHUNK", 700)
    assert (s.signatures(h, at) == whole).all()


def test_equal_places_estimate_the_similarity():
    rnd = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.9):
        n, spread = 50, []
        for _ in range(200):
            both = rnd.integers(0, 2**63, 2 * n).astype(np.uint64)
            common = round(n * share)
            a, b = both[:n], np.concatenate([both[:common], both[n : 2 * n - common]])
            x = s.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            spread.append((x[0] == x[1]).mean())
        j = common / (2 * n - common)
        assert abs(np.mean(spread) - j) < 0.01
        assert np.var(spread) < j * (1 - j) / s.PLACES  # independent hashes have this variance


def test_odd_rows(spark, odd_docs, no_docs):
    assert s.groups(no_docs).count() == 0
    got = sorted((tuple(r) for r in s.groups(odd_docs).collect()), key=str)
    assert len(got) == 6 and all(r[3] for r in got) and sum(1 for r in got if r[0] is None) == 2
