"""Product codes against a plain refit."""

import hashlib
import math
import random

import numpy as np
import pytest

from folioforge.llm import productcodes

DDL = "vec_id long, embedding array<float>, label int, id int, v string, code int"


def brute(rows, parts=4, entries=256, rounds=4):
    good = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]], r[2]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(r[1]) for r in good) // parts)
    x = [[(r[1] + [0] * (parts * width))[k * width : (k + 1) * width] for k in range(parts)] for r in good]
    books = [[v[k] for v in x[:entries]] for k in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            of = [near(v[k], books[k])[1] for v in x]
            for i in range(len(books[k])):
                mine = [v[k] for v, o in zip(x, of, strict=True) if o == i]
                if mine:
                    books[k][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[near(v[k], books[k]) for k in range(parts)] for v in x]
    error = [sum(d for d, _ in p) for p in last]
    label = {}
    for r, e in zip(good, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in p), e, label[r[2]], digest) for r, p, e in zip(good, last, error, strict=True)), key=str)


def made(n, width, seed=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(width)] for _ in range(9)]
    out = [(i * 7 % 1009, [c + rnd.gauss(0, 0.05) for c in rnd.choice(centres)], rnd.choice([0, 0, 1, None]), 1, "v", 2) for i in range(n)]
    out += [(2000 + i, out[i % 5][1], 1, None, None, None) for i in range(20)]  # copies: equal entries and ties
    return out


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "width", "entries"), [(400, 16, 256), (300, 8, 12), (9, 8, 256), (150, 7, 5)])
def test_codes_are_brute_force(spark, n, width, entries):
    rows = made(n, width)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    assert result(productcodes.compressed(spark, df, entries=entries)) == brute(rows, entries=entries)


def test_bounds_spare_scans(spark):
    rows, kept = made(900, 16), []
    assert result(productcodes.compressed(spark, spark.createDataFrame(rows, DDL), entries=9, kept=kept)) == brute(rows, entries=9)
    books, scans = kept
    assert books.shape == (4, 9, 4) and scans[0] == 4 * 920 and sum(scans[1:]) < 2 * scans[0]


def test_grid_ties_are_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.randrange(3) / 1024 for _ in range(8)], i % 3, 1, "", 1) for i in range(500)]
    assert result(productcodes.compressed(spark, spark.createDataFrame(rows, DDL), entries=20)) == brute(rows, entries=20)


def test_odd_vectors(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 1), (None, [0.5] * 8, None), (5, [0.25] * 8, None), (5, [0.125] * 8, None), (6, [], 2), (7, [0.1] * 3, 2), (8, [1e7] * 8, 2), (9, [-3e15] * 8, 3)]
    rows = [(*r, 0, "", 0) for r in rows]
    assert result(productcodes.compressed(spark, spark.createDataFrame(rows, DDL), entries=3)) == [(*r[:2], *(min(x, 2**63 - 1) for x in r[2:4]), r[4]) for r in brute(rows, entries=3)]


def test_no_vectors(spark):
    assert result(productcodes.compressed(spark, spark.createDataFrame([], DDL))) == []
    assert result(productcodes.compressed(spark, spark.createDataFrame([(1, None, 1, 1, "", 1)], DDL))) == []


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(productcodes, "LABELS", 1)
    rows = made(120, 8)
    assert result(productcodes.compressed(spark, spark.createDataFrame(rows, DDL), entries=7)) == brute(rows, entries=7)
