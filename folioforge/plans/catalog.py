"""Queries of the document catalog and the summary cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.operators import catalog as op
from folioforge.operators.vectors import ranked
from folioforge.plans.registry import query

C = fx.CATALOG
NEW = "(SELECT doc_id, file_path, file_hash FROM " + C + " WHERE doc_id % 3 <> 0)"


@query("cat_add_document", f"SELECT doc_id, file_path, '{{\"rank\":\"' || doc_id % 7 || '\"}}' AS metadata_json FROM {C} n WHERE file_path NOT IN (SELECT file_path FROM {C} WHERE doc_id % 3 = 0)")
def _(t):
    extra = F.create_map(F.lit("rank"), (F.col("doc_id") % 7).cast("string"))
    out = op.added(fx.catalog(t).where("doc_id % 3 = 0"), fx.catalog(t), extra)
    return out.select("doc_id", "file_path", "metadata_json")


@query("cat_get_document", f"SELECT * FROM {C} WHERE file_path = '/docs/src3/3.txt' OR doc_id IN (5, 8)")
def _(t):
    return fx.catalog(t).where((F.col("file_path") == "/docs/src3/3.txt") | F.col("doc_id").isin(5, 8))


@query("cat_update_document", f"SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'renamed ' || doc_id ELSE title END AS title, author, language, doc_id % 10 = 1 AS touched FROM {C}")
def _(t):
    changes = fx.catalog(t).where("doc_id % 10 = 1").select("doc_id", F.concat(F.lit("renamed "), F.col("doc_id").cast("string")).alias("title"))
    return op.updated(fx.catalog(t), changes, ["title"]).select("doc_id", "title", "author", "language", "touched")


@query("cat_list_documents", f"SELECT doc_id, title, author, total_tokens FROM {C} WHERE author ILIKE '%SRC1%' AND doc_type = 'other' ORDER BY total_tokens DESC, doc_id LIMIT 100")
def _(t):
    return op.listed(fx.catalog(t), doc_type="other", author="SRC1").select("doc_id", "title", "author", "total_tokens")


@query("cat_find_documents", f"SELECT doc_id FROM {C} WHERE author = 'src3' AND language = 'en'")
def _(t):
    return op.found(fx.catalog(t), author="src3", language="en").select("doc_id")


@query("cat_delete_document", f"SELECT 'documents' AS kind, count(*) AS n FROM {C} WHERE doc_id % 50 <> 0 UNION ALL SELECT 'chunks', count(*) FROM {fx.VECTORS} WHERE doc_id % 50 <> 0")
def _(t):
    gone = fx.catalog(t).where("doc_id % 50 = 0").select("doc_id")
    kept = {k: df.join(gone, "doc_id", "left_anti") for k, df in (("documents", fx.catalog(t)), ("chunks", fx.vectors(t)))}
    return kept["documents"].agg(F.lit("documents").alias("kind"), F.count("*").alias("n")).union(kept["chunks"].agg(F.lit("chunks"), F.count("*")))


@query("cat_get_chunk_meta", f"SELECT chunk_id, doc_id, chunk_number FROM {fx.VECTORS} WHERE doc_id BETWEEN 3 AND 9")
def _(t):
    return fx.vectors(t).where("doc_id BETWEEN 3 AND 9").orderBy("doc_id", "chunk_number").select("chunk_id", "doc_id", "chunk_number")


@query("cat_get_chapters", f"SELECT DISTINCT doc_id, chunk_number // 2 AS chapter_num FROM {fx.VECTORS}")
def _(t):
    return fx.vectors(t).select("doc_id", F.floor(F.col("chunk_number") / 2).cast("int").alias("chapter_num")).distinct()


@query("cat_surrounding", f"SELECT a.chunk_id AS target, b.chunk_id, b.chunk_number FROM {fx.VECTORS} a JOIN {fx.VECTORS} b ON a.doc_id = b.doc_id AND b.chunk_number BETWEEN greatest(0, a.chunk_number - 1) AND a.chunk_number + 1")
def _(t):
    return op.surrounding(fx.vectors(t), fx.vectors(t), 1).select("target", "chunk_id", "chunk_number")


@query("cat_stats", f"SELECT count(*) AS documents, (SELECT count(*) FROM {fx.VECTORS}) AS chunks, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM {C}")
def _(t):
    chunks = fx.vectors(t).agg(F.count("*").alias("chunks"))
    return fx.catalog(t).agg(F.count("*").alias("documents"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")).crossJoin(chunks)  # one row each


@query("cat_recent_docs", f"SELECT doc_id, left(title, 30) AS title, left(author, 20) AS author FROM {C} ORDER BY doc_id DESC LIMIT 5")
def _(t):
    return fx.catalog(t).orderBy(F.desc("doc_id")).limit(5).select("doc_id", F.substring("title", 1, 30).alias("title"), F.substring("author", 1, 20).alias("author"))


@query("cat_inspect", f"SELECT v.chunk_id, v.collection, c.title, v.chunk_number, len(v.embedding) AS dims FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY md5(chunk_id::VARCHAR), chunk_id) AS place FROM {fx.VECTORS}) WHERE place <= 20) v LEFT JOIN {C} c USING (doc_id)")
def _(t):
    """A sample of 20 rows of each collection: those of least hash, whatever the order; each
    task keeps its 20 before they meet."""
    few = ranked(fx.vectors(t).withColumn("dims", F.size("embedding").cast("long")).drop("embedding"), ["collection"], [F.md5(F.col("chunk_id").cast("string").cast("binary")), F.col("chunk_id")], 20)
    return few.join(fx.catalog(t).select("doc_id", "title"), "doc_id", "left").select("chunk_id", "collection", "title", "chunk_number", "dims")


@query("cat_list_collections", f"SELECT db, collection, count(*) AS n FROM {fx.VECTORS} GROUP BY ALL")
def _(t):
    return fx.vectors(t).groupBy("db", "collection").agg(F.count("*").alias("n"))


# The cache: a log of summaries of files; every fifth file came twice, with another hash.
def log(t):
    c = fx.catalog(t).select("file_path", "file_hash", "doc_id", "total_tokens")
    first = c.where("doc_id % 2 = 0").select("file_path", F.when(F.col("doc_id") % 10 == 0, F.md5(F.col("file_hash"))).otherwise(F.col("file_hash")).alias("file_hash"), "doc_id", "total_tokens", F.lit(1).alias("seq"))
    again = c.where("doc_id % 20 = 0").select("file_path", "file_hash", "doc_id", "total_tokens", F.lit(2).alias("seq"))
    return first.unionByName(again)


LOG = f"(SELECT file_path, CASE WHEN doc_id % 10 = 0 THEN md5(file_hash) ELSE file_hash END AS file_hash, doc_id, total_tokens, 1 AS seq FROM {C} WHERE doc_id % 2 = 0 UNION ALL SELECT file_path, file_hash, doc_id, total_tokens, 2 AS seq FROM {C} WHERE doc_id % 20 = 0)"
CACHE = f"(SELECT file_path, max_by(file_hash, seq) AS file_hash, max_by(doc_id, seq) AS doc_id, max_by(total_tokens, seq) AS total_tokens, max(seq) AS seq FROM {LOG} GROUP BY file_path)"


@query("cache_upsert", f"SELECT * FROM {CACHE}")
def _(t):
    return op.latest(log(t), ["file_path"], "seq")


@query("cache_lookup", f"SELECT c.doc_id, k.seq FROM {C} c JOIN {CACHE} k USING (file_path, file_hash)")
def _(t):
    return fx.catalog(t).select("doc_id", "file_path", "file_hash").join(op.latest(log(t), ["file_path"], "seq").drop("doc_id"), ["file_path", "file_hash"]).select("doc_id", "seq")


@query("cache_change_detect", f"SELECT coalesce(c.file_path, k.file_path) AS file_path, CASE WHEN k.file_path IS NULL THEN 'new' WHEN c.file_path IS NULL THEN 'gone' WHEN c.file_hash = k.file_hash THEN 'hit' ELSE 'stale' END AS state FROM (SELECT * FROM {C} WHERE doc_id % 9 <> 0) c FULL JOIN {CACHE} k ON c.file_path = k.file_path")
def _(t):
    return op.changes(fx.catalog(t).where("doc_id % 9 <> 0"), op.latest(log(t), ["file_path"], "seq"))


@query("cache_delete", f"SELECT file_path FROM {CACHE} WHERE doc_id % 6 <> 0")
def _(t):
    gone = fx.catalog(t).where("doc_id % 6 = 0").select("file_path")
    return op.latest(log(t), ["file_path"], "seq").join(gone, "file_path", "left_anti").select("file_path")


@query("cache_list", f"SELECT file_path, seq FROM {CACHE} ORDER BY seq DESC, file_path LIMIT 25")
def _(t):
    return op.latest(log(t), ["file_path"], "seq").orderBy(F.desc("seq"), "file_path").limit(25).select("file_path", "seq")


@query("cache_stats", f"SELECT count(*) AS summaries, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {CACHE}")
def _(t):
    return op.latest(log(t), ["file_path"], "seq").agg(F.count("*").alias("summaries"), F.sum("total_tokens").alias("tokens"))


ANCHOR = "2024-02-01 00:00:00"


@query("cache_expire", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{ANCHOR}' - INTERVAL 14 DAY")
def _(t):
    """What stays after entries older than 14 days before a fixed anchor go."""
    return t.events.where(F.col("ts") >= F.expr(f"timestamp_ntz'{ANCHOR}' - INTERVAL 14 DAYS")).select("event_id")


@query("cache_get_chunks", f"SELECT doc_id, chunk_number, chunk_id FROM {fx.VECTORS} WHERE doc_id IN (SELECT doc_id FROM {CACHE})")
def _(t):
    kept = op.latest(log(t), ["file_path"], "seq").select("doc_id")
    return fx.vectors(t).join(kept, "doc_id", "left_semi").select("doc_id", "chunk_number", "chunk_id")


@query("cache_store_chunks", f"SELECT doc_id, CAST(coalesce(CASE WHEN chunk_number <> 3 THEN chunk_number END, 0) AS INTEGER) AS chunk_number, coalesce(CASE WHEN chunk_number <> 2 THEN collection END, '') AS content FROM {fx.VECTORS}")
def _(t):
    holes = fx.vectors(t).select("doc_id", F.when(F.col("chunk_number") != 3, F.col("chunk_number")).alias("chunk_number"), F.when(F.col("chunk_number") != 2, F.col("collection")).alias("content"))
    return holes.select("doc_id", F.coalesce("chunk_number", F.lit(0)).alias("chunk_number"), F.coalesce("content", F.lit("")).alias("content"))
