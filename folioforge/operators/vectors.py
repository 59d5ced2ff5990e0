"""Exact vector search, fusion and ranking over stored vector rows.

Queries are a stated set. They and the rows are counted and dealt to blocks of bounded
size; each block of queries meets each block of rows in a group of its own, as two matrices
(`matrices.py`), and the best of each block are ranked. Rows of the store are never paired
with each other. Ranks carry explicit ties: distance (null ones last), then chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioforge.functions.text import let
from folioforge.operators import matrices

#: Queries, and bytes of them, that may travel to all tasks at once; more are dealt to blocks.
QUERIES, BYTES = 1024, 32 << 20
#: Rows and queries of a block at most, where the best are looked for and where all pairs come
#: out. Each row travels once for each block of queries and the other way round, so blocks are
#: large, but not so large that tasks go without one, unless they got fewer rows than LEAST.
SEARCHED, LISTED, LEAST = (65_536, 65_536), (65_536, 65_536), 4096
TASKS = 8192  # of a stage, at most
MANY = 1 << 20  # queries without their vectors that may travel to all tasks at once


def folded(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return folded(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    return folded(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def similarity(distance: Column) -> Column:
    return F.when(distance <= 1, 1 - distance).otherwise(0.0)


def ranked(df: DataFrame, keys: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def blocks(queries: DataFrame, most: int | None = None, tasks: int = 1) -> int:
    """Into how many blocks queries (or rows) are dealt, by number and size; into `tasks` if
    there are enough of them."""
    size = lambda f: F.octet_length(f.name) if f.dataType.typeName() == "string" else 8 * F.size(f.name) if f.dataType.typeName() == "array" else F.lit(8)
    n, bytes_ = queries.agg(F.count("*"), F.sum(sum((F.coalesce(size(f), F.lit(8)) for f in queries.schema), F.lit(0)))).first()
    return max(1, -(-n // (most or QUERIES)), -(-(bytes_ or 0) // BYTES), min(tasks, n // LEAST))


def tasks(spark: SparkSession) -> int:
    """Groups that keep all cores busy, though some cores get more of them than others."""
    return 3 * spark.sparkContext.defaultParallelism


def paired(rows: DataFrame, queries: DataFrame, itself: bool = False, also: Column | None = None) -> DataFrame:
    """Each row with each query (but for the one of its own id, unless `itself`) for which
    `also` holds, in blocks of queries."""
    other, n = (F.lit(True) if itself else F.col("chunk_id") != F.col("query_id")), blocks(queries)
    other = other if also is None else other & also
    if n == 1:
        return rows.join(F.broadcast(queries), other)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = rows.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return met.join(dealt, ["_part", "_block"]).where(other).drop("_part", "_block")


def grouped(asked: DataFrame, stored: DataFrame, groups: int, meet, schema: StructType) -> DataFrame:
    """What `meet` yields, as Arrow tables, of the queries and the rows of each `_group` of so
    many, numbered from 0, each a task; tables leave it as they come, so of a result only one
    is held at a time."""
    ours, theirs = ([c for c in t.columns if c != "_group"] for t in (asked, stored))
    every = asked.withColumn("_asks", F.lit(True)).unionByName(stored.withColumn("_asks", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        a, b = both.filter(both["_asks"]).select(ours), both.filter(pc.invert(both["_asks"])).select(theirs)
        del both
        if len(a) and len(b):
            for out in meet(a, b):
                yield from out.combine_chunks().to_batches()

    return every.repartitionById(min(groups, TASKS), "_group").groupBy("_group").applyInArrow(run, schema)


def met(rows: DataFrame, queries: DataFrame, meet, schema: StructType, size: tuple[int, int]) -> DataFrame:
    """What `meet` yields of each block of queries and each block of rows. Rows and queries
    without an id meet nothing."""
    rows, queries = rows.where("chunk_id IS NOT NULL"), queries.where("query_id IS NOT NULL")
    n, m = blocks(rows, size[0], tasks(rows.sparkSession)), blocks(queries, size[1])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = queries.select("*", deal(m, "query_id").alias("_block"), each(n).alias("_part"))
    stored = rows.select("*", deal(n, "chunk_id", "embedding").alias("_part"), each(m).alias("_block"))
    asked, stored = (t.withColumn("_group", F.col("_block") * n + F.col("_part")).drop("_block", "_part") for t in (asked, stored))
    return grouped(asked, stored, n * m, meet, schema)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", keys: tuple[str, ...] = (), passing: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """query_id, the row's columns, distance and rank of the k nearest rows of each query
    (and each value of `keys`, such as the collection), other than the query itself. With
    `passing` (doc_id, filters), a query with a `filter` sees rows of documents that pass it:
    the filters of a row's document travel with the row and are looked at where it meets the
    query, so queries and documents are never paired. With `most`, rows that can't be among
    the `most` most similar of all keys may be left out."""
    queries = queries.select("query_id", F.col("query").cast("array<double>").alias("query"), *(["filter"] if passing is not None else []))
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    if passing is not None:
        rows = rows.join(passing.withColumnRenamed("filters", "_filters"), "doc_id", "left")
    kept = [c for c in rows.columns if c not in ("embedding", "_filters")]
    schema = StructType([queries.schema["query_id"], *(rows.schema[c] for c in kept), StructField("distance", DoubleType())])

    def meet(asked: pa.Table, stored: pa.Table) -> Iterator[pa.Table]:
        i, j, d, none = matrices.nearest(asked, stored, k, metric, keys, most)
        out = stored.select(kept).take(pa.array(j)).add_column(0, "query_id", asked["query_id"].take(pa.array(i)))
        yield out.append_column("distance", pa.array(d, mask=none))

    return ranked(met(rows, queries, meet, schema, SEARCHED), ["query_id", *keys], [F.asc_nulls_last("distance"), F.col("chunk_id")], k)


def similarities(rows: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, chunk_id and the rounded cosine of each row with each query but its own."""
    rows = rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    schema = StructType([queries.schema["query_id"], rows.schema["chunk_id"], StructField("similarity", DoubleType())])
    return met(rows, queries, lambda a, b: matrices.cosines(a, b, digits), schema, LISTED)


def over_collections(rows: DataFrame, queries: DataFrame, k: int, passing: DataFrame | None = None) -> DataFrame:
    """k of each collection, then the k most similar of all, ties by collection and rank there."""
    hits = nearest(rows, queries, min(k, 100), keys=("collection_ord",), passing=passing, most=k if k <= 100 else None).withColumnRenamed("rank", "dist_rank").withColumn("similarity", similarity(F.col("distance")))
    return ranked(hits, ["query_id"], [F.desc("similarity"), F.asc_nulls_last("collection_ord"), F.col("dist_rank")], k, "hit_rank")


def dual(rows: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """k of each database, importance weighted by database, the k most important of all."""
    hits = nearest(rows, queries, k, keys=("db",)).withColumnRenamed("rank", "dist_rank")
    private = F.col("db") == "private"
    hits = hits.withColumn("weighted", F.col("importance") * F.when(private, weights[0]).otherwise(weights[1]))
    return ranked(hits, ["query_id"], [F.desc("weighted"), F.when(private, 0).otherwise(1), F.col("dist_rank")], k)


def expanded(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunks before and after them: first visit of a (document, number) wins,
    neighbours carry 0.7 of the hit's similarity. chunks: one row of each (doc_id, chunk_number)."""
    slots = hits.select("query_id", "hit_rank", "doc_id", "similarity", F.col("chunk_id").alias("hit_id"), F.col("chunk_number").alias("hit_number"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot"))
    slots = slots.withColumn("chunk_number", F.col("hit_number") + F.col("slot") - 1).where("chunk_number >= 0")
    known = chunks.select("doc_id", "chunk_number", F.col("chunk_id").alias("near_id"))
    rows = slots.join(known, ["doc_id", "chunk_number"], "left").where((F.col("slot") == 1) | F.col("near_id").isNotNull())
    rows = rows.select("query_id", "doc_id", "chunk_number", "hit_rank", "slot", F.when(F.col("slot") == 1, F.col("hit_id")).otherwise(F.col("near_id")).alias("chunk_id"), F.when(F.col("slot") == 1, F.col("similarity")).otherwise(0.7 * F.col("similarity")).alias("similarity"))
    first = ranked(rows, ["query_id", "doc_id", "chunk_number"], [F.col("hit_rank"), F.col("slot")], 1, "visit")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank", "slot"))).drop("visit")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has; words by white space, lower case."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(text))) / F.size(q))


def final_score(similarity: Column, rerank: Column, author_hit: Column, chapter_hit: Column, has_summary: Column) -> Column:
    s = F.when(rerank > 0, 0.4 * similarity + 0.6 * rerank).otherwise(similarity)
    for hit, boost in ((author_hit, 1.2), (chapter_hit, 1.15), (has_summary, 1.05)):
        s = s * F.when(hit, boost).otherwise(1.0)
    return F.least(s, F.lit(1.0))


MODES = {"fast": (10, 5, False, False), "balanced": (20, 10, True, False), "accurate": (50, 20, True, True), "thorough": (100, 50, True, True)}


def filters(queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries with the key of their `filter`, an author (a part of the name, without
    case) and a language; null where they name none, or one that no document passes, as such
    a query isn't filtered. And doc_id, filters: the keys that each document passes.

    Distinct filters meet distinct pairs of author and language only, which carry the keys
    that they pass as a sorted set; documents take theirs by those two values."""
    wanted, spoken = F.lower("author"), F.col("language")
    keyed = queries.withColumn("filter", F.when(F.col("author").isNotNull() | F.col("language").isNotNull(), F.xxhash64(wanted, spoken)))
    asks = keyed.where("filter IS NOT NULL").select(F.col("filter").alias("query_id"), wanted.alias("_wanted"), spoken.alias("_spoken")).distinct()
    kinds = documents.select(F.col("author").alias("_author"), F.col("language").alias("_language")).distinct()
    fits = (F.col("_wanted").isNull() | F.contains(F.lower("_author"), F.col("_wanted"))) & (F.col("_spoken").isNull() | (F.col("_language") == F.col("_spoken")))
    kinds = kinds.withColumn("chunk_id", F.xxhash64("_author", "_language"))
    sets = paired(kinds, asks, itself=True, also=fits).groupBy("_author", "_language").agg(F.sort_array(F.collect_set("query_id")).alias("filters"))
    passing = documents.join(sets, documents["author"].eqNullSafe(sets["_author"]) & documents["language"].eqNullSafe(sets["_language"])).select("doc_id", "filters")
    live = sets.select(F.explode("filters").alias("filter")).distinct().withColumn("_live", F.lit(True))
    keyed = keyed.join(live, "filter", "left").withColumn("filter", F.when(F.col("_live"), F.col("filter"))).drop("_live")
    return keyed, passing


def choices(queries: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, doc_id of the documents that pass each filtered query's filter; and query_id
    of the queries that aren't filtered.

    There are few filters and each has many documents and queries, so the pairs are far more
    than both: documents are dealt by their ids, each part meets all queries (of few bytes,
    else copies of them for each part), and no pair moves."""
    keyed, passing = filters(queries, documents)
    asks, spark = keyed.where("filter IS NOT NULL").select("query_id", "filter"), queries.sparkSession
    parts = max(tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = passing.repartition(parts, "doc_id").select("doc_id", F.explode("filters").alias("filter"))
    if blocks(asks, MANY) == 1:
        pairs = rows.join(F.broadcast(asks), "filter")
    else:
        each = asks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).join(each, ["filter", "_part"])
    return pairs.select("query_id", "doc_id"), keyed.where("filter IS NULL").select("query_id")


def filtered(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents that pass each filtered query's filter."""
    return choices(queries, documents)[0]


def reranked(hits: DataFrame, texts: DataFrame, queries: DataFrame, k: int, score=overlap) -> DataFrame:
    """The k hits of each query whose texts score best against its words (ties by position),
    with that score and their new position; texts: chunk_id, content."""
    rows = hits.join(texts, "chunk_id", "left").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    rows = rows.withColumn("rerank", score(F.coalesce("question", F.lit("")), F.coalesce("content", F.lit("")))).drop("content", "question")
    return ranked(rows, ["query_id"], [F.desc("rerank"), F.col("position")], k, "place").drop("position").withColumnRenamed("place", "position")


def retrieve(rows: DataFrame, queries: DataFrame, documents: DataFrame, mode: str, texts: DataFrame | None = None, score=overlap) -> DataFrame:
    """The retrieval pipeline: filter, search, expand, rerank or cut, score with boosts,
    order; one plan for all queries. queries may carry author, language, chapter and the
    question's text; documents author, language and summary; rows chapter. Modes that
    rerank do so where the chunks' texts are given."""
    initial, final, expands, reranks = MODES[mode]
    has = set(queries.columns)
    for name, kind in (("author", "string"), ("language", "string"), ("chapter", "int"), ("text", "string")):
        queries = queries if name in has else queries.withColumn(name, F.lit(None).cast(kind))
    passing = None
    if has & {"author", "language"}:
        queries, passing = filters(queries, documents)
    hits = over_collections(rows, queries, initial, passing)
    if expands:
        near = rows.where(F.col("collection_ord").isin(0, 1, 2)).withColumn("priority", F.when(F.col("collection_ord") == 0, 0).when(F.col("collection_ord") == 2, 1).otherwise(2))
        near = ranked(near, ["doc_id", "chunk_number"], [F.col("priority"), F.col("chunk_id")], 1, "first")
        hits = expanded(hits, near)
    else:
        hits = hits.withColumn("position", F.col("hit_rank"))
    if reranks and texts is not None:
        cut = reranked(hits, texts, queries, final, score)
    else:
        cut = hits.where(F.col("position") <= final).withColumn("rerank", F.lit(0.0))
    known = documents.select("doc_id", "title", *([c for c in ("author", "summary") if c in documents.columns]))
    cut = cut.join(known, "doc_id", "left").join(queries.select("query_id", F.lower("author").alias("wanted"), F.col("chapter").alias("asked_chapter")), "query_id")
    author = F.contains(F.lower("author"), F.col("wanted")) if "author" in known.columns else F.lit(False)
    chapter = F.col("chapter") == F.col("asked_chapter") if "chapter" in rows.columns else F.lit(False)
    if "chapter" in rows.columns and "chapter" not in cut.columns:
        cut = cut.join(rows.select("chunk_id", "chapter"), "chunk_id", "left")
    summary = F.coalesce(F.col("summary"), F.lit("")) != "" if "summary" in known.columns else F.lit(False)
    cut = cut.withColumn("score", final_score(F.col("similarity"), F.col("rerank"), author, chapter, summary))
    out = ranked(cut, ["query_id"], [F.desc("score"), F.col("position")], final)
    return out.select("query_id", "rank", "chunk_id", "doc_id", "chunk_number", F.coalesce("title", F.lit("Unknown")).alias("title"), F.round("score", 6).alias("score"))
