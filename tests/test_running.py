"""Running sums, keyed tables and halved chunks."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import summaries
from folioforge.operators.running import running
from folioforge.sources.keyed import KeyedTable


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_sums_are_brute_force(spark, ranges):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, *range(9)])) for i in range(500)]
    rnd.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k string, i long, v long").repartition(3), ["k"], ["i"], {"total": "v"}, ranges)
    so_far, want = {}, []
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        so_far[k] = so_far.get(k, 0) + (v or 0)
        want.append((k, i, v, so_far[k]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    if ranges > 1:
        spread = got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
        assert spread > 1  # the hot key isn't one task
    assert running(got.limit(0).select("k", "i", "v"), ["k"], ["i"], {"total": "v"}).count() == 0


def test_merges_move_only_the_changes(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i) for i in range(1000)] + [(None, "x", 1)], "id long, name string, n long")
    table = KeyedTable(spark, "id", buckets=4).create(rows)
    changes = spark.createDataFrame([(5, None, 50), (5, None, 40), (2000, "new", None), (None, "y", 1)], "id long, name string, n long")
    for plan in (table.merged(changes), table.remaining(changes)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        below = text[text.index("FileScan") :] if "FileScan" in text else ""
        scan = next(line for line in text.splitlines() if "FileScan" in line)
        above = text[: text.index(scan)].splitlines()
        depth = len(scan) - len(scan.lstrip(" :+-"))
        assert below and "Bucketed: true" in text and "SelectedBucketsCount: 4 out of 4" in text
        parents = []
        for line in reversed(above):
            d = len(line) - len(line.lstrip(" :+-"))
            if d < depth:
                parents.append(line)
                depth = d
        assert not [x for x in parents if "Exchange" in x], text
    table.merge(changes)
    got = {r.id: (r.name, r.n) for r in table.read().where("id IN (5, 6, 2000)").collect()}
    assert got == {5: ("t5", 50), 6: ("t6", 6), 2000: ("new", None)} and table.read().count() == 1001
    table.delete(rows.where("id < 990").select("id"))
    assert table.read().count() == 11 and table.version == 3
    table.drop()


def brute_pieces(text, room):
    parts = 1
    while parts < 2**summaries.DEPTH and -(-len(text) // parts) > room:
        parts *= 2
    size = -(-len(text) // parts) if text else 0
    return [text[i * size : (i + 1) * size] for i in range(parts)]


def test_chunks_are_halved_until_they_fit(spark):
    rnd = random.Random(3)
    texts = ["", "a", "x" * 83, "x" * 84, *("".join(rnd.choice("abc é") for _ in range(n)) for n in (200, 333, 700, 1500, 5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, chunk string").withColumn("chunk_number", F.lit(0))
    got = {r.doc_id: r.p for r in df.select("doc_id", summaries.pieces(F.col("chunk"), 83).alias("p")).collect()}
    assert got == {i: brute_pieces(t, 83) for i, t in enumerate(texts)}
    whole = lambda c: c
    made = summaries.mapped(df, whole, context=50, prompt=10, reply=10).collect()  # room for 20 tokens
    assert {r.doc_id: r.summary for r in made} == {i: " ".join(x for x in brute_pieces(t, 83) if x or len(t) <= 83) for i, t in enumerate(texts)}


def test_pieces_that_fail_are_quartered(spark):
    picky = lambda c: F.when(F.length(c) <= 30, F.upper(c))
    df = spark.createDataFrame([(1, 0, "a" * 30), (2, 0, "b" * 100), (3, 0, "c" * 200)], "doc_id int, chunk_number int, chunk string")
    got = {r.doc_id: r.summary for r in summaries.mapped(df, picky).collect()}
    assert got == {1: "A" * 30, 2: " ".join(["B" * 25] * 4), 3: ""}
