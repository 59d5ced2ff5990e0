"""Queries of vector search, retrieval, reranking and context building."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.operators import index as ivf
from folioforge.operators import postings
from folioforge.operators import vectors as op
from folioforge.operators.running import running
from folioforge.plans.registry import dealt, dealt_sql, inline, query, values

V, Q, C = fx.VECTORS, fx.ASKED, fx.CATALOG
L2 = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(query, embedding)])"
COS = "1 - list_dot_product(query, embedding) / (sqrt(list_dot_product(query, query)) * sqrt(list_dot_product(embedding, embedding)))"


def knn(k: int, metric: str = L2, where: str = "true", keys: str = "", rows: str = V, name: str = "rank") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id{keys} ORDER BY distance, chunk_id) AS {name} FROM (SELECT q.query_id, v.* EXCLUDE (embedding), {metric} AS distance FROM {rows} v, {Q} q WHERE v.chunk_id <> q.query_id AND {where})) WHERE {name} <= {k})"


SIM = "CASE WHEN distance <= 1 THEN 1 - distance ELSE 0 END"


@query("knn_l2", f"SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM {knn(10)}")
def _(t):
    return op.nearest(fx.vectors(t), fx.asked(t), 10).select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query("knn_cosine", f"SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM {knn(10, COS)}")
def _(t):
    return op.nearest(fx.vectors(t), fx.asked(t), 10, "cosine").select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query("knn_filtered", f"SELECT query_id, rank, chunk_id FROM {knn(5, where=chr(39).join(['collection IN (', 'documents', ', ', 'semantic', ') AND db = ', 'private', '']))}")
def _(t):
    rows = fx.vectors(t).where(F.col("collection").isin("documents", "semantic") & (F.col("db") == "private"))
    return op.nearest(rows, fx.asked(t), 5).select("query_id", "rank", "chunk_id")


@query("knn_similarity", f"SELECT query_id, chunk_id, round({SIM}, 6) AS similarity FROM {knn(20)}")
def _(t):
    return op.nearest(fx.vectors(t), fx.asked(t), 20).select("query_id", "chunk_id", F.round(op.similarity(F.col("distance")), 6).alias("similarity"))


@query("knn_similarity_raw", f"SELECT query_id, chunk_id, round(1 - distance, 6) AS similarity FROM {knn(20)}")
def _(t):
    return op.nearest(fx.vectors(t), fx.asked(t), 20).select("query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("knn_cli_query", f"SELECT query_id, rank, chunk_id, round(1 - distance, 6) AS similarity FROM {knn(3, where=chr(39).join(['collection = ', 'documents', '']))}")
def _(t):
    return op.nearest(fx.vectors(t).where("collection = 'documents'"), fx.asked(t), 3).select("query_id", "rank", "chunk_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


def multi(k: int, rows: str = V, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, collection_ord, dist_rank) AS hit_rank FROM (SELECT *, {SIM} AS similarity FROM {knn(min(k, 100), where=where, keys=', collection_ord', rows=rows, name='dist_rank')})) WHERE hit_rank <= {k})"


@query("knn_multi_collection", f"SELECT query_id, hit_rank, chunk_id, collection, round(similarity, 6) AS similarity FROM {multi(10)}")
def _(t):
    return op.over_collections(fx.vectors(t), fx.asked(t), 10).select("query_id", "hit_rank", "chunk_id", "collection", F.round("similarity", 6).alias("similarity"))


WEIGHED = f"(SELECT v.*, CASE WHEN l.quality = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS importance FROM {V} v LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"


def weighed(t):
    marks = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return fx.vectors(t).join(marks, "doc_id", "left").withColumn("importance", F.when(F.col("quality") == 1, 0.7).otherwise(0.5)).drop("quality")


DUAL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, CASE WHEN db = 'private' THEN 0 ELSE 1 END, dist_rank) AS rank FROM (SELECT *, importance * CASE WHEN db = 'private' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS weighted FROM {knn(8, keys=', db', rows=WEIGHED, name='dist_rank')})) WHERE rank <= 8)"


@query("knn_dual_weighted", f"SELECT query_id, rank, chunk_id, db, round(weighted, 6) AS weighted FROM {DUAL}")
def _(t):
    return op.dual(weighed(t), fx.asked(t), 8).select("query_id", "rank", "chunk_id", "db", F.round("weighted", 6).alias("weighted"))


@query("mem_retrieve", f"SELECT query_id, place, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, pick, rank) AS place FROM (SELECT *, 1 AS pick FROM {DUAL.replace(WEIGHED, '(SELECT * FROM ' + WEIGHED + ' WHERE collection_ord = 1)')} UNION ALL SELECT *, 2 FROM {DUAL.replace(WEIGHED, '(SELECT * FROM ' + WEIGHED + ' WHERE collection_ord = 2)')} UNION ALL SELECT *, 3 FROM {DUAL.replace(WEIGHED, '(SELECT * FROM ' + WEIGHED + ' WHERE collection_ord = 0)')})) WHERE place <= 8")
def _(t):
    """Episodic, semantic and documents, each from both databases; ordered by importance."""
    rows = weighed(t)
    parts = [op.dual(rows.where(F.col("collection_ord") == c), fx.asked(t), 8).withColumn("pick", F.lit(k)) for k, c in enumerate((1, 2, 0), 1)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return op.ranked(every, ["query_id"], [F.desc("weighted"), F.col("pick"), F.col("rank")], 8, "place").select("query_id", "place", "chunk_id")


@query("vec_get_where", f"SELECT chunk_id, doc_id FROM {V} WHERE db = 'public' AND collection = 'semantic'")
def _(t):
    return fx.vectors(t).where("db = 'public' AND collection = 'semantic'").select("chunk_id", "doc_id")


@query("vec_count", f"SELECT collection, count(*) AS n FROM {V} GROUP BY collection")
def _(t):
    return fx.vectors(t).groupBy("collection").agg(F.count("*").alias("n"))


@query("vec_metadata_flatten", f"SELECT chunk_id, db AS kind, CASE WHEN chunk_number = 2 THEN 'override' ELSE collection END AS source FROM {V}")
def _(t):
    """Fixed keys first; a row's own metadata overrides them."""
    fixed = F.create_map(F.lit("kind"), F.col("db"), F.lit("source"), F.col("collection"))
    own = F.when(F.col("chunk_number") == 2, F.create_map(F.lit("source"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(fixed, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return fx.vectors(t).withColumn("m", merged).select("chunk_id", F.col("m")["kind"].alias("kind"), F.col("m")["source"].alias("source"))


@query("vec_parse_defaults", f"SELECT chunk_id, coalesce(CASE WHEN chunk_number > 0 THEN collection END, 'unknown') AS kind, coalesce(CASE WHEN chunk_number > 1 THEN db END, '') AS at, coalesce(CASE WHEN chunk_number > 2 THEN 0.9::DOUBLE END, 0.5::DOUBLE) AS importance, 0 AS access_count FROM {V}")
def _(t):
    n = F.col("chunk_number")
    return fx.vectors(t).select("chunk_id", F.coalesce(F.when(n > 0, F.col("collection")), F.lit("unknown")).alias("kind"), F.coalesce(F.when(n > 1, F.col("db")), F.lit("")).alias("at"), F.coalesce(F.when(n > 2, 0.9), F.lit(0.5)).alias("importance"), F.lit(0).alias("access_count"))


@query("lance_json_rows", f"SELECT chunk_id::VARCHAR AS id, '{{\"db\":\"' || db || '\",\"collection\":\"' || collection || '\"}}' AS metadata, CASE WHEN chunk_number = 4 THEN 384 ELSE len(embedding) END AS dims FROM {V}")
def _(t):
    vector = F.coalesce(F.when(F.col("chunk_number") != 4, F.col("embedding")), F.array_repeat(F.lit(0.0), 384))
    return fx.vectors(t).select(F.col("chunk_id").cast("string").alias("id"), F.to_json(F.struct("db", "collection")).alias("metadata"), F.size(vector).cast("long").alias("dims"))


@query("emb_normalize", "SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS u FROM (SELECT vec_id, [x * 3 FOR x IN embedding::DOUBLE[]] AS e FROM embeddings))")
def _(t):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return t.embeddings.select("vec_id", op.unit(e).alias("u")).select("vec_id", F.round(op.norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


@query("emb_similarity", f"SELECT query_id, chunk_id, round(1 - ({COS}), 6) AS similarity FROM {V} v JOIN {Q} q ON v.chunk_id <> q.query_id")
def _(t):
    return op.similarities(fx.vectors(t), fx.asked(t)).select("query_id", "chunk_id", "similarity")


EMB_DDL = "name string, device string, configured int"
EMB = [("all-MiniLM-L6-v2", "gpu", None), ("all-mpnet-base-v2", "gpu", None), ("bge-large-en", "cpu", None), ("x", "cpu", 40), ("multi-qa-mpnet", "cpu", None)]


@query("emb_batch_size", f"SELECT name, device, coalesce(configured, CASE WHEN device = 'gpu' THEN 64 ELSE 16 END // CASE WHEN contains(name, 'mpnet') OR contains(name, 'large') THEN 2 ELSE 1 END) AS batch FROM {dealt_sql(EMB, EMB_DDL)}")
def _(t):
    heavy = F.contains("name", F.lit("mpnet")) | F.contains("name", F.lit("large"))
    each = F.when(F.col("device") == "gpu", 64).otherwise(16)
    return dealt(t, EMB, EMB_DDL).select("name", "device", F.coalesce("configured", F.when(heavy, each / 2).otherwise(each).cast("int")).alias("batch"))


@query("emb_dimension", f"SELECT name, CASE WHEN contains(name, 'mpnet') THEN 768 ELSE 384 END AS dims FROM {dealt_sql(EMB, EMB_DDL)}")
def _(t):
    return dealt(t, EMB, EMB_DDL).select("name", F.when(F.contains("name", F.lit("mpnet")), 768).otherwise(384).alias("dims"))


ROUTE_DDL = "task string, private string, public string"
ROUTES = [("debugging", "episodic,procedural", "documents"), ("research", "semantic", "documents,papers"), ("coding", "procedural", "")]
ASK_DDL = "task string"
TASKS = [("debugging",), ("research",), ("coding",), ("cooking",)]


@query("route_collections", f"SELECT a.task, CASE WHEN r.task IS NULL THEN 'documents' ELSE r.private || CASE WHEN r.public <> '' THEN ',' || r.public ELSE '' END END AS collections FROM {dealt_sql(TASKS, ASK_DDL)} a LEFT JOIN {values(ROUTES, ROUTE_DDL)} r ON a.task = r.task")
def _(t):
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    rows = dealt(t, TASKS, ASK_DDL).join(inline(t, ROUTES, ROUTE_DDL), "task", "left")
    flat = F.array_join(F.concat(split(F.col("private")), split(F.col("public"))), ",")
    return rows.select("task", F.coalesce(flat, F.lit("documents")).alias("collections"))


MODE_DDL = "id int, mode string, initial_k int, final_k int, expands boolean, reranks boolean"
MODES = [(k, m, *c) for k, (m, c) in enumerate(op.MODES.items())]


@query("cfg_quality_modes", f"SELECT id, mode, initial_k, final_k, expands, reranks FROM {dealt_sql(MODES, MODE_DDL)}")
def _(t):
    """The settings of the mode that each document's request asks for."""
    return dealt(t, MODES, MODE_DDL).drop("form")


NEAR = f"(SELECT doc_id, chunk_number, chunk_id AS near_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_number ORDER BY CASE collection_ord WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, chunk_id) AS first FROM {V} WHERE collection_ord IN (0, 1, 2)) WHERE first = 1)"


def expand(k: int, where: str = "true") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank, slot) AS position FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_number ORDER BY hit_rank, slot) AS visit FROM (
        SELECT h.query_id, h.doc_id, h.chunk_number + s.slot - 1 AS chunk_number, h.hit_rank, s.slot, CASE WHEN s.slot = 1 THEN h.chunk_id ELSE n.near_id END AS chunk_id, CASE WHEN s.slot = 1 THEN h.similarity ELSE 0.7::DOUBLE * h.similarity END AS similarity
        FROM {multi(k, where=where)} h CROSS JOIN (SELECT unnest([0, 1, 2]) AS slot) s LEFT JOIN {NEAR} n ON n.doc_id = h.doc_id AND n.chunk_number = h.chunk_number + s.slot - 1
        WHERE h.chunk_number + s.slot - 1 >= 0 AND (s.slot = 1 OR n.near_id IS NOT NULL))) WHERE visit = 1))"""


# What the survey says of the whole pipeline: filter, search, expansion, rerank or cut, boosts, order.
ALLOWED = f"(SELECT q.query_id, d.doc_id FROM {fx.INTENTS} q JOIN {C} d ON (q.author IS NULL OR contains(lower(d.author), lower(q.author))) AND (q.language IS NULL OR d.language = q.language) WHERE q.author IS NOT NULL OR q.language IS NOT NULL)"
FILTERED = f"(NOT EXISTS (SELECT 1 FROM {ALLOWED} a WHERE a.query_id = q.query_id) OR EXISTS (SELECT 1 FROM {ALLOWED} a WHERE a.query_id = q.query_id AND a.doc_id = v.doc_id))"
WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> ''))"


def over(q: str, text: str) -> str:
    return f"CASE WHEN len({WORDS.format(q)}) = 0 THEN 0 ELSE len(list_intersect({WORDS.format(q)}, {WORDS.format(text)}))::DOUBLE / len({WORDS.format(q)}) END"


def rerank(hits: str, k: int) -> str:
    scored_ = f"SELECT h.*, {over('coalesce(q.text, $$$$)', 'coalesce(t.content, $$$$)')} AS rerank FROM {hits} h LEFT JOIN {fx.CONTENTS} t ON t.chunk_id = h.chunk_id JOIN {fx.INTENTS} q ON q.query_id = h.query_id"
    return f"(SELECT * REPLACE (place AS position) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, position) AS place FROM ({scored_})) WHERE place <= {k})"


def pipeline(mode: str) -> str:
    initial, final, expands, reranks = op.MODES[mode]
    hits = expand(initial, FILTERED) if expands else f"(SELECT *, hit_rank AS position FROM {multi(initial, where=FILTERED)})"
    hits = rerank(hits, final) if reranks else f"(SELECT *, 0.0::DOUBLE AS rerank FROM {hits} WHERE position <= {final})"
    score = "least(CASE WHEN rerank > 0 THEN 0.4::DOUBLE * similarity + 0.6::DOUBLE * rerank ELSE similarity END * CASE WHEN contains(lower(c.author), lower(q.author)) THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN h.chunk_number // 2 = q.chapter THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN h.doc_id % 4 = 0 AND c.doc_id IS NOT NULL THEN 1.05::DOUBLE ELSE 1 END, 1.0::DOUBLE)"
    rows = f"SELECT h.query_id, h.chunk_id, h.doc_id, h.chunk_number, h.position, c.title, {score} AS score FROM {hits} h LEFT JOIN {C} c ON c.doc_id = h.doc_id JOIN {fx.INTENTS} q ON q.query_id = h.query_id"
    return f"SELECT query_id, rank, chunk_id, doc_id, chunk_number, coalesce(title, 'Unknown') AS title, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM ({rows}))"


def retrieved(t, mode: str):
    """Chapters are pairs of chunks; every fourth document has a summary."""
    rows = fx.vectors(t).withColumn("chapter", F.floor(F.col("chunk_number") / 2).cast("int"))
    documents = fx.catalog(t).withColumn("summary", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("About "), "title")))
    return op.retrieve(rows, fx.intents(t), documents, mode, fx.contents(t))


for _mode in op.MODES:

    @query(f"ret_pipeline_{_mode}", pipeline(_mode))
    def _(t, mode=_mode):
        return retrieved(t, mode)


@query("ret_semantic", f"SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM {multi(20)}")
def _(t):
    return op.over_collections(fx.vectors(t), fx.asked(t), 20).select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("ret_expand_context", f"SELECT query_id, position, doc_id, chunk_number, chunk_id, slot, round(similarity, 6) AS similarity FROM {expand(20)}")
def _(t):
    rows = fx.vectors(t)
    near = op.ranked(rows.where("collection_ord IN (0, 1, 2)").withColumn("p", F.when(F.col("collection_ord") == 0, 0).when(F.col("collection_ord") == 2, 1).otherwise(2)), ["doc_id", "chunk_number"], [F.col("p"), F.col("chunk_id")], 1, "first")
    return op.expanded(op.over_collections(rows, fx.asked(t), 20), near).select("query_id", "position", "doc_id", "chunk_number", "chunk_id", "slot", F.round("similarity", 6).alias("similarity"))


SCORED = f"(SELECT query_id, chunk_id, least(1.0::DOUBLE, CASE WHEN rerank > 0 THEN 0.4 * similarity + 0.6 * rerank ELSE similarity END * CASE WHEN doc_id % 3 = 0 THEN 1.2 ELSE 1 END * CASE WHEN chunk_number = 2 THEN 1.15 ELSE 1 END * CASE WHEN db = 'private' THEN 1.05 ELSE 1 END) AS score FROM (SELECT *, (chunk_id % 10)::DOUBLE / 10 AS rerank FROM {multi(20)}))"


def scored(t):
    s = op.final_score(F.col("similarity"), (F.col("chunk_id") % 10) / 10, F.col("doc_id") % 3 == 0, F.col("chunk_number") == 2, F.col("db") == "private")
    return op.over_collections(fx.vectors(t), fx.asked(t), 20).withColumn("score", s)


@query("ret_final_score", f"SELECT query_id, chunk_id, round(score, 6)::DOUBLE AS score FROM {SCORED}")
def _(t):
    return scored(t).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("ret_order", f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM {SCORED}")
def _(t):
    return op.ranked(scored(t).withColumn("r", F.round("score", 6)), ["query_id"], [F.desc("r"), F.col("chunk_id")], 1 << 30, "place").select("query_id", "chunk_id", "place")


@query("ret_rerank_stage", f"SELECT query_id, chunk_id, position, round(rerank, 6) AS rerank FROM {rerank(expand(50), 20)}")
def _(t):
    rows = fx.vectors(t)
    near = op.ranked(rows.where("collection_ord IN (0, 1, 2)").withColumn("p", F.when(F.col("collection_ord") == 0, 0).when(F.col("collection_ord") == 2, 1).otherwise(2)), ["doc_id", "chunk_number"], [F.col("p"), F.col("chunk_id")], 1, "first")
    hits = op.expanded(op.over_collections(rows, fx.asked(t), 50), near)
    return op.reranked(hits, fx.contents(t), fx.intents(t), 20).select("query_id", "chunk_id", "position", F.round("rerank", 6).alias("rerank"))


@query("ret_stats", f"SELECT query_id, count(*) AS final_count, count(DISTINCT title) AS titles, round(max(score), 6) AS best FROM ({pipeline('balanced')}) GROUP BY query_id")
def _(t):
    return retrieved(t, "balanced").groupBy("query_id").agg(F.count("*").alias("final_count"), F.countDistinct("title").alias("titles"), F.max("score").alias("best"))


@query("ret_format", f"SELECT query_id, string_agg('[' || rank || '] Score: ' || printf('%.3f', score) || ' Title: ' || title, chr(10) ORDER BY rank) AS shown FROM ({pipeline('balanced')}) GROUP BY query_id")
def _(t):
    rows = retrieved(t, "balanced")
    line = F.format_string("[%d] Score: %.3f Title: %s", "rank", "score", "title")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("shown"))


@query("ret_metadata_filter", f"SELECT query_id, doc_id FROM {ALLOWED} UNION ALL SELECT query_id, NULL FROM {fx.INTENTS} WHERE query_id NOT IN (SELECT query_id FROM {ALLOWED})")
def _(t):
    """Documents of each question's author and language; null for a question that asks for
    none or fits none, which is not filtered."""
    allowed, free = op.choices(fx.intents(t), fx.catalog(t))
    return allowed.unionByName(free.withColumn("doc_id", F.lit(None).cast("long")))


@query("ret_context_window", f"SELECT chunk_id, (i - 1) AS idx, n AS total, i > 1 AS can_prev, i < n AS can_next, round(i / n::DOUBLE, 6) AS progress, greatest(i - 2, 1) - 1 AS from_idx, least(i + 2, n) - 1 AS to_idx FROM (SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_number) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM {V})")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    rows = fx.vectors(t).select("chunk_id", F.row_number().over(w.orderBy("chunk_number")).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    i, n = F.col("i"), F.col("n")
    return rows.select("chunk_id", (i - 1).alias("idx"), n.alias("total"), (i > 1).alias("can_prev"), (i < n).alias("can_next"), F.round(i / n, 6).alias("progress"), (F.greatest(i - 2, F.lit(1)) - 1).alias("from_idx"), (F.least(i + 2, n) - 1).alias("to_idx"))


@query("ret_doc_chunks", f"SELECT chunk_id, chunk_number FROM {V} WHERE doc_id = 7")
def _(t):
    return fx.vectors(t).where("doc_id = 7").orderBy("chunk_number").select("chunk_id", "chunk_number")


@query("ret_chunk_search", "SELECT doc_id, CASE WHEN p > 51 THEN '...' ELSE '' END || substr(text, greatest(1, p - 50), least(length(text), p - 1 + 4 + 50) - greatest(0, p - 51)) || CASE WHEN p - 1 + 4 + 50 < length(text) THEN '...' ELSE '' END AS preview FROM (SELECT doc_id, text, instr(lower(text), 'ther') AS p FROM documents) WHERE p > 0")
def _(t):
    """Texts with the words looked for, found by the trigram index and checked."""
    p, n = F.col("p"), F.length("text")
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    rows = postings.containing(texts, postings.bitmaps(texts), "ther").withColumnsRenamed({"id": "doc_id", "at": "p"})
    start, end = F.greatest(F.lit(0), p - 51), F.least(n, p - 1 + 4 + 50)
    return rows.select("doc_id", F.concat(F.when(start > 0, "...").otherwise(""), F.substring("text", start + 1, end - start), F.when(end < n, "...").otherwise("")).alias("preview"))


@query("ret_chunk_by_id", "SELECT chunk_id, regexp_extract(chunk_id, '^(.*)_chunk_', 1) AS doc FROM (SELECT 'doc_a_chunk_x_' || doc_id || '_chunk_' || doc_id % 4 AS chunk_id FROM documents)")
def _(t):
    made = F.concat(F.lit("doc_a_chunk_x_"), F.col("doc_id").cast("string"), F.lit("_chunk_"), (F.col("doc_id") % 4).cast("string"))
    return t.documents.select(made.alias("chunk_id")).select("chunk_id", F.regexp_extract("chunk_id", "^(.*)_chunk_", 1).alias("doc"))


# Reranking: benchmark items with ids divisible by 50 ask, all documents answer.
OVERLAPS = f"(SELECT item_id, doc_id, {over('q', 'text')} AS overlap FROM (SELECT item_id, text AS q FROM benchmark WHERE item_id % 50 = 0) b, (SELECT doc_id, text FROM documents) d)"
NEAREST = f"(SELECT *, rank AS position FROM {knn(10)})"


@query("rerank_overlap", f"SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM {OVERLAPS}")
def _(t):
    """Each document's share of each question's words; a text is cut into words once."""
    asked = t.benchmark.where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), postings.words(F.col("text")).alias("q"))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), postings.words(F.col("text")).alias("words"))
    n = F.array_size("q")
    overlap = F.when(n == 0, F.lit(0.0)).otherwise(F.array_size(F.array_intersect("q", "words")) / n)
    return op.paired(texts, asked, itself=True).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round(overlap, 6).alias("overlap"))


@query("retr_rerank_k", f"SELECT query_id, chunk_id, CAST(position AS INTEGER) AS place FROM {rerank(NEAREST, 5)}")
def _(t):
    """Twice as many nearest chunks as wanted, the better half by their words."""
    hits = op.nearest(fx.vectors(t), fx.asked(t), 10).withColumnRenamed("rank", "position")
    return op.reranked(hits, fx.contents(t), fx.intents(t), 5).select("query_id", "chunk_id", F.col("position").alias("place"))


@query("idx_knn_exact", f"SELECT query_id, rank, chunk_id, round(distance, 6) AS distance FROM {knn(10)}")
def _(t):
    """The nearest ten from the inverted-file index, exact by its bounds."""
    hits, _ = ivf.exact(ivf.built(fx.vectors(t)), fx.asked(t), 10)
    return hits.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query("idx_knn_codes")
def _(t):
    """The nearest ten by codes; no SQL, as some may be missed: recall is tested."""
    hits = ivf.search(ivf.built(fx.vectors(t)), fx.asked(t), 10)
    return hits.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


@query("ctx_budget", "SELECT source, doc_id, CASE WHEN before + tokens <= 2000 THEN text ELSE left(text, CAST((2000 - before) * 4 AS BIGINT)) || '...' END AS part FROM (SELECT source, doc_id, text, length(text) // 4 AS tokens, coalesce(sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before + tokens <= 2000 OR (before <= 2000 AND (2000 - before) * 4 > 100)")
def _(t):
    """Documents of a source, in order, until 2000 tokens; at most the last one is cut. Only
    the lengths are summed up; texts are read for the few documents that stay."""
    tokens = F.floor(F.length("text") / 4).cast("long")
    sums = running(t.documents.select("source", "doc_id", tokens.alias("tokens")), ["source"], ["doc_id"], {"upto": "tokens"})
    left = 2000 - (F.col("upto") - F.col("tokens"))
    fits = F.col("upto") <= 2000
    kept = sums.where(fits | ((left >= 0) & (left * 4 > 100))).select("doc_id", fits.alias("fits"), (left * 4).cast("int").alias("room"))
    rows = t.documents.select("source", "doc_id", "text").join(kept, "doc_id")
    return rows.select("source", "doc_id", F.when(F.col("fits"), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.col("room")), F.lit("..."))).alias("part"))


@query("ctx_qa", "SELECT source, string_agg('[Source ' || n || ' - ' || doc_id || ', Chunk ?]' || chr(10) || CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END || chr(10), chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY source")
def _(t):
    rows = op.ranked(t.documents, ["source"], [F.col("doc_id")], 5, "n")
    body = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text"))
    part = F.concat(F.lit("[Source "), F.col("n").cast("string"), F.lit(" - "), F.col("doc_id").cast("string"), F.lit(", Chunk ?]\n"), body, F.lit("\n"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))).alias("l")).select("source", F.array_join(F.transform("l", lambda x: x["p"]), "\n").alias("context"))


@query("ctx_knowledge", r"SELECT source, string_agg(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 500), '|' ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10 GROUP BY source")
def _(t):
    from folioforge.functions.text import flat

    rows = op.ranked(t.documents, ["source"], [F.col("doc_id")], 10, "n")
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", F.substring(flat(F.col("text")), 1, 500).alias("p")))).alias("l")).select("source", F.array_join(F.transform("l", lambda x: x["p"]), "|").alias("context"))


# Answers over the hits of each query.
HITS = f"(SELECT query_id, hit_rank, chunk_id, similarity, CASE WHEN chunk_id % 4 = 0 THEN -similarity ELSE similarity END AS score FROM {multi(10)})"


def hits(t):
    return op.over_collections(fx.vectors(t), fx.asked(t), 10).withColumn("score", F.when(F.col("chunk_id") % 4 == 0, -F.col("similarity")).otherwise(F.col("similarity")))


@query("qa_confidence", f"SELECT query_id, round(least(1.0, avg(CASE WHEN score < 0 THEN 1 / (1 + abs(score)) ELSE score END)), 6)::DOUBLE AS confidence FROM {HITS} GROUP BY query_id")
def _(t):
    s = F.col("score")
    return hits(t).groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.avg(F.when(s < 0, 1 / (1 + F.abs(s))).otherwise(s))), 6).alias("confidence"))


@query("qa_low_conf", f"SELECT query_id FROM (SELECT query_id, avg(similarity) AS c FROM {HITS} GROUP BY query_id) WHERE c < 0.3")
def _(t):
    return hits(t).groupBy("query_id").agg(F.avg("similarity").alias("c")).where("c < 0.3").select("query_id")


@query("kn_confidence", f"SELECT query_id, round(least(1.0, avg(similarity)), 6)::DOUBLE AS confidence, CASE WHEN avg(similarity) > 0.7 THEN 'green' WHEN avg(similarity) > 0.4 THEN 'yellow' ELSE 'red' END AS band FROM {HITS} WHERE hit_rank <= 3 GROUP BY query_id")
def _(t):
    c = F.avg("similarity")
    return hits(t).where("hit_rank <= 3").groupBy("query_id").agg(F.round(F.least(F.lit(1.0), c), 6).alias("confidence"), F.when(c > 0.7, "green").when(c > 0.4, "yellow").otherwise("red").alias("band"))


@query("qa_sources", f"SELECT query_id, hit_rank AS source_number, CASE WHEN chunk_id % 5 = 3 THEN '?' ELSE (chunk_id % 5)::VARCHAR END AS chunk_number, round(similarity, 6) AS relevance FROM {HITS}")
def _(t):
    n = F.when(F.col("chunk_number") != 3, F.col("chunk_number").cast("string"))
    return hits(t).select("query_id", F.col("hit_rank").alias("source_number"), F.coalesce(n, F.lit("?")).alias("chunk_number"), F.round("similarity", 6).alias("relevance"))


@query("kn_sources", f"SELECT query_id, chunk_id, printf('%.2f', similarity) AS shown, coalesce(title, 'Unknown') AS title FROM {multi(10)} h LEFT JOIN {C} c USING (doc_id)")
def _(t):
    return hits(t).join(fx.catalog(t).select("doc_id", "title"), "doc_id", "left").select("query_id", "chunk_id", F.format_string("%.2f", "similarity").alias("shown"), F.coalesce("title", F.lit("Unknown")).alias("title"))


@query("kn_fallback_answer", f"SELECT h.query_id, 'Found relevant information: ' || left(d.text, 300) || '...' AS answer FROM {multi(10)} h JOIN documents d USING (doc_id) WHERE hit_rank = 1")
def _(t):
    top = hits(t).where("hit_rank = 1").join(t.documents.select("doc_id", "text"), "doc_id")
    return top.select("query_id", F.concat(F.lit("Found relevant information: "), F.substring("text", 1, 300), F.lit("...")).alias("answer"))
