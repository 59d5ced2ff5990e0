"""The vector index, word postings, trigram bitmaps and filters against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import providers
from folioforge.operators import index as ivf
from folioforge.operators import matrices, postings, vectors
from folioforge.plans.registry import Tables

VECTORS = "chunk_id long, embedding array<double>"


def test_codes_reach_a_recall_of_nine_tenths(spark):
    """Against the exact search over all rows, with the vectors of 2 % of the rows read."""
    t = Tables(spark, "/root/testdata/sf0.1")
    rows, asked = fx.vectors(t), fx.asked(t)
    n, index = rows.count(), ivf.built(rows)
    assert index.rows.count() == index.codes.count() == index.lists.agg(F.sum("n")).first()[0] == n
    want = {(r.query_id, r.chunk_id) for r in vectors.nearest(rows, asked, 10).collect()}
    got = {(r.query_id, r.chunk_id) for r in ivf.search(index, asked, 10, kept=4).collect()}
    assert 4 * 10 < 0.1 * n and len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        best = sorted((round(float(((np.array(v) - np.array(x)) ** 2).sum()), 9), i) for i, x in rows if i is not None and x is not None and i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(best, 1)]
    return sorted(out)


def test_exact_search_passes_rows_over_and_misses_none(spark, monkeypatch):
    """One list with most rows in parts, copies with equal distances, rows without id or vector."""
    monkeypatch.setattr(ivf, "PART", 40)
    monkeypatch.setattr(ivf, "BLOCK", 3)
    rnd = np.random.default_rng(5)
    middles = rnd.normal(0, 5, (12, 6))
    rows = [(i, (middles[0 if i % 3 else i % 12] + rnd.normal(0, 0.2, 6)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i % 4][1]) for i in range(30)] + [(None, rows[0][1]), (7000, None)]
    asked = [(i, rows[i][1]) for i in range(0, 600, 50)] + [(9000, [50.0] * 6)]
    df, queries = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, "query_id long, query array<double>")
    index = ivf.built(df, lists=12)
    assert index.lists.agg(F.max("parts")).first()[0] > 1
    hits, seen = ivf.exact(index, queries, 5, probes=2)
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 9)) for r in hits.collect()) == brute(rows, asked, 5)
    assert seen.where("query_id < 600").agg(F.avg("seen")).first()[0] < 0.9 * len(rows)
    few = ivf.built(df.where("chunk_id < 3"), lists=2)
    assert [r.n for r in ivf.exact(few, queries, 5)[0].groupBy("query_id").agg(F.count("*").alias("n")).where("query_id = 9000").collect()] == [3]
    none = ivf.built(df.limit(0))
    assert none.rows.count() == 0 and len(none.centres) == 0


def test_best_overlaps_are_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(300)]
    texts = [(i, " ".join([*common, *rnd.sample(rare, rnd.randrange(1, 12))]).title()) for i in range(400)] + [(500, None), (501, ""), (502, "alone")]
    asked = [(i, " ".join([*common[: i % 5], *rnd.sample(rare, 5), "nowhere"])) for i in range(20)] + [(50, ""), (51, None), (52, "nowhere at all"), (53, "alone the")]
    index = postings.indexed(spark.createDataFrame(texts, "id long, text string").repartition(3))
    want = []
    for q, t in asked:
        a = set((t or "").lower().split())
        best = sorted((-len(a & set((x or "").lower().split())) / len(a), i) for i, x in texts)[:6] if a else []
        want += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(best, 1) if s]
    for first in (postings.FIRST, 3):
        monkeypatch.setattr(postings, "FIRST", first)
        got = postings.best(index, spark.createDataFrame(asked, "query_id long, text string"), 6).collect()
        assert sorted((r.query_id, r["rank"], r.id, round(r.overlap, 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("needle", ["ab", "abc", "Bcab", "zzzz", "ßé a"])
def test_needles_are_found(spark, needle):
    rnd = random.Random(4)
    rows = [(i - 100, "".join(rnd.choice("abcABß é") for _ in range(rnd.randrange(0, 40)))) for i in range(300)] + [(900, None), (901, "ab"), (902, "xßÉ A")]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r["at"] for r in postings.containing(texts, postings.bitmaps(texts), needle).collect()}
    assert got == {i: t.lower().find(needle.lower()) + 1 for i, t in rows if t and needle.lower() in t.lower()}


def test_filters_pair_no_query_with_a_document(spark):
    documents = spark.createDataFrame([(1, "Ann Lee", "en"), (2, "Bob", "en"), (3, None, "fr"), (4, "Leeds", None)], "doc_id long, author string, language string")
    queries = spark.createDataFrame([(10, "lee", None), (11, None, "en"), (12, "LEE", "en"), (13, "nobody", None), (14, None, None), (15, None, "fr")], "query_id long, author string, language string")
    got = sorted(tuple(r) for r in vectors.filtered(queries, documents).collect())
    assert got == [(10, 1), (10, 4), (11, 1), (11, 2), (12, 1), (15, 3)]
    keyed, passing = vectors.filters(queries, documents)
    assert {r.query_id for r in keyed.where("filter IS NULL").collect()} == {13, 14}
    assert passing.count() == 4 and "query_id" not in passing.columns


@pytest.mark.parametrize("many", [vectors.MANY, 2])
def test_filtered_pairs_do_not_move(spark, monkeypatch, many):
    """A filter with most documents and queries is many tasks; queries without one come out once."""
    monkeypatch.setattr(vectors, "MANY", many)
    documents = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("Ann").alias("author"), F.when(F.col("id") % 10 > 0, "en").otherwise("fr").alias("language"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.when(F.col("id") % 8 == 1, "nobody").alias("author"), F.when(F.col("id") % 4 > 0, "en").alias("language"))
    pairs, free = vectors.choices(queries, documents)
    each = pairs.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in each) == 25 * 1800 and max(r["count"] for r in each) < 0.5 * 25 * 1800
    assert pairs.distinct().count() == 25 * 1800 and pairs.select("query_id").distinct().count() == 25
    assert sorted(r.query_id for r in free.collect()) == [q for q in range(40) if q % 4 == 0 or q % 8 == 1]


def test_blocks_follow_bytes(spark, monkeypatch):
    queries = spark.createDataFrame([(i, [0.5] * 100) for i in range(8)], "query_id long, query array<double>")
    assert vectors.blocks(queries) == 1 and vectors.blocks(queries.limit(0)) == 1
    monkeypatch.setattr(vectors, "BYTES", 2000)
    assert vectors.blocks(queries) == 4


def test_scorers_are_called_by_the_batch(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "x")], "q string, t string").coalesce(1)
    each = providers.scored(lambda q, t: [len(x) + 10 * len(q) for x in t])
    assert [r[0] for r in rows.select(each("q", "t")).collect()] == [23.0, 21.0]
    assert [r[0] for r in rows.select(providers.scored()(F.coalesce("q", F.lit("")), F.col("t"))).collect()] == [0.5, 0.0]


ODD = [[0.5, 0.25, -1.0], [0.5, 0.25, -1.0], [0.1, 0.2, 0.3], [0.0, 0.0, 0.0], [1e200, 1.0, 0.0], [0.5, float("nan"), 1.0], [0.5, None, -1.0], [0.5, 0.25], [], None, [1.0, 1.0, 1.0, 1.0], [0.1, 0.2, 0.3], [-0.4, 0.1, 0.2], [0.3, -0.3, 0.9], [0.7, 0.1, -0.2]]


def test_blocks_of_vectors_give_what_sql_gives(spark, monkeypatch):
    """Copies, null, empty, short, long and not finite vectors, in blocks of a few rows."""
    duckdb = pytest.importorskip("duckdb")
    from folioforge.plans import search

    odd = [[1e30, 1.0, 0.0] if v and v[0] == 1e200 else v for v in ODD]  # of floats
    rows = [(i, odd[i % len(odd)], (i % 7) if i % 11 else None) for i in range(400)]
    t = type("T", (), {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    number = lambda v: None if v is None else str(float(f"{v:.6g}"))
    for size in (vectors.SEARCHED, (64, 3)):
        monkeypatch.setattr(vectors, "SEARCHED", size)
        got = vectors.nearest(fx.vectors(t), fx.asked(t), 40).select("query_id", "rank", "chunk_id", "distance").collect()
        want = c.sql(f"SELECT query_id, rank, chunk_id, distance FROM {search.knn(40)}").fetchall()
        assert sorted((*r[:3], number(r[3])) for r in got) == sorted((*r[:3], number(r[3])) for r in want)
        got = vectors.over_collections(fx.vectors(t), fx.asked(t), 30).select("query_id", "hit_rank", "chunk_id").collect()
        assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT query_id, hit_rank, chunk_id FROM {search.multi(30)}").fetchall())


@pytest.mark.parametrize("size", [None, (64, 3)])
def test_cosines_of_blocks_are_those_of_expressions(spark, monkeypatch, size):
    rnd = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, (ODD + rnd.normal(0, 1, (30, 3)).tolist())[i % 45]) for i in range(200)], VECTORS)
    asked = rows.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    if size:
        monkeypatch.setattr(vectors, "SEARCHED", size)
        monkeypatch.setattr(vectors, "LISTED", size)
    pairs = vectors.paired(rows, asked).withColumn("s", vectors.cosine(F.col("query"), F.col("embedding")))
    want = sorted((r.query_id, r.chunk_id, str(r.s)) for r in pairs.select("query_id", "chunk_id", F.round("s", 6).alias("s")).collect())
    assert sorted((r.query_id, r.chunk_id, str(r.similarity)) for r in vectors.similarities(rows, asked).collect()) == want
    best = vectors.ranked(pairs.withColumn("distance", 1 - F.col("s")), ["query_id"], [F.asc_nulls_last("distance"), F.col("chunk_id")], 50)
    got = vectors.nearest(rows, asked, 50, "cosine")
    assert sorted((r.query_id, r["rank"], r.chunk_id, str(r.distance)) for r in got.collect()) == sorted((r.query_id, r["rank"], r.chunk_id, str(r.distance)) for r in best.collect())


def recorded(monkeypatch, module) -> list:
    """What `grouped` of a module gets and makes."""
    out, real = [], module.grouped
    monkeypatch.setattr(module, "grouped", lambda asked, stored, *more: out.append((asked, stored, made := real(asked, stored, *more))) or made)
    return out


def test_blocks_of_pairs_let_little_travel(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = rows.where("chunk_id < 2500").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    seen = recorded(monkeypatch, vectors)
    assert vectors.similarities(rows, asked).count() == 2500 * 8999
    assert seen[0][0].count() + seen[0][1].count() <= 9000 + 3 * 2500


def test_pairs_come_in_tables_of_bounded_size():
    x = np.random.default_rng(0).normal(0, 1, (10_000, 3)).tolist()
    rows = pa.table({"chunk_id": range(10_000), "embedding": x})
    asked = pa.table({"query_id": range(-300, 0), "query": x[:300]})
    sizes = [len(t) for t in matrices.cosines(asked, rows, 6)]
    assert max(sizes) <= 1 << 20 and sum(sizes) == 300 * 10_000


def test_exact_search_compares_rows_without_bounds(spark, monkeypatch):
    """Numbers that are missing or not finite rule out no list; ids that occur twice; few rows a shelf."""
    monkeypatch.setattr(ivf, "LEAST", 50)
    rnd = np.random.default_rng(8)
    odd = [[float("nan"), 0.0, 0.0], [0.1, None, 0.2], [1e200, 0.0, 1.0], [float("inf"), 0.0, 0.0]]
    rows = [(i, (10 * (i % 9) + rnd.normal(0, 1, 3)).tolist()) for i in range(500)] + [(600 + i, v) for i, v in enumerate(odd)] + [(50, [0.0, 0.0, 0.0])] * 12
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")).dropDuplicates(["query_id"])
    asked = asked.localCheckpoint()
    want = sorted((r.query_id, r["rank"], r.chunk_id, str(r.distance)) for r in vectors.nearest(df, asked, 7).collect())
    hits, seen = ivf.exact(ivf.built(df, lists=9), asked, 7, probes=1)
    assert sorted((r.query_id, r["rank"], r.chunk_id, str(r.distance)) for r in hits.collect()) == want
    assert seen.where("query_id < 600").agg(F.avg("seen")).first()[0] < 0.9 * len(rows)


def test_visits_of_lists_are_no_rows(spark, monkeypatch):
    """A query meets shelves of many lists: as many rows as shelves, and `most` codes of each."""
    rnd = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, rnd.normal(0, 1, 4).tolist()) for i in range(3000)], VECTORS)
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    index = ivf.built(rows, lists=100)
    seen = recorded(monkeypatch, ivf)
    for search in (ivf.search(index, asked, 5, kept=4), ivf.exact(index, asked, 5)[0], ivf.search(index, asked, 5, probes=100, kept=4)):
        want = {(r.query_id, r.chunk_id) for r in vectors.nearest(rows, asked, 5).collect()}
        assert len(want & {(r.query_id, r.chunk_id) for r in search.collect()}) >= 0.9 * len(want)
    for met, _, made in seen:
        assert met.count() <= 60 and made.count() <= 60 * 20
