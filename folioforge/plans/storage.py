"""Queries of sources, sinks, the store, the stream and model providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import providers, replies, text
from folioforge.operators import sessions as sess
from folioforge.operators import vectors as vec
from folioforge.plans.registry import dealt, dealt_sql, inline, query
from folioforge.plans.search import NEAREST, multi, rerank
from folioforge.session import fresh_path
from folioforge.sources import files, pdf
from folioforge.sources.keyed import KeyedTable
from folioforge.sources.store import Store, updated
from folioforge.streaming import requests
from folioforge.streaming.sinks import BatchSink

V = fx.VECTORS


#: A file is read as one value.
FILE_BYTES = 32 << 20


def stored(t, rows=None) -> Store:
    store = Store(t.spark, fresh_path(t.spark, "store"))
    store.add(rows if rows is not None else fx.vectors(t))
    return store


@query("src_text_read", "SELECT count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents WHERE text <> ''")
def _(t):
    """All texts written as files and read back; as many to a file as surely fit in FILE_BYTES."""
    path = fresh_path(t.spark, "texts")
    rows = t.documents.where("text <> ''").select("text")
    longest = rows.agg(F.coalesce(F.max(F.octet_length("text")), F.lit(1))).first()[0]
    rows.write.option("lineSep", "\u0001").option("maxRecordsPerFile", max(1, FILE_BYTES // longest)).text(path)
    rows = files.texts(t.spark, path).select(F.explode(F.split("text", "\u0001")).alias("x")).where("x <> ''")
    return rows.agg(F.count("*").alias("texts"), F.sum(F.length("x")).alias("characters"))


# One PDF for each document: 40 lines a page.
LINES = "(SELECT doc_id, (i - 1) // 40 AS page, i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
PAGES = f"(SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS body FROM {LINES} GROUP BY ALL)"


def sql_pdf(page: str) -> str:
    return f"SELECT d.doc_id, p.text, CASE WHEN p.text IS NULL THEN 'error' ELSE 'success' END AS status FROM documents d LEFT JOIN (SELECT doc_id, string_agg({page}, chr(10) || chr(10) ORDER BY page) AS text FROM {PAGES} WHERE trim(body, ' ' || chr(9) || chr(10)) <> '' GROUP BY doc_id) p USING (doc_id)"


def printed(t):
    """The documents as PDF files: doc_id, path, content."""
    rows = t.documents.select("doc_id", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.split("text", "\n").alias("lines"))
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 40).cast("int")), lambda k: F.slice("lines", k * 40 + 1, F.lit(40)))
    return rows.select("doc_id", "path", pages.alias("pages")).mapInPandas(pdf.printed, "doc_id long, path string, content binary")


def read_back(t, numbered: bool):
    made = printed(t).withColumn("doc", F.col("doc_id"))
    return files.pdf_texts(made, numbered=numbered).select(F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("doc_id"), "text", "status")


@query("src_pdf_read", sql_pdf("body"))
def _(t):
    """Pages of text joined by blank lines, blank pages left out."""
    return read_back(t, False)


@query("src_pdf_marked", sql_pdf("'[Page ' || page + 1 || ']' || chr(10) || body"))
def _(t):
    """The second reader: kept pages begin with their number, blank ones counted."""
    return read_back(t, True)


META_DDL = "path string, title string, author string"
META = [("/a/one_{}.pdf", "Real Title", "Ann"), ("/a/two_{}.pdf", " ", None), ("/b/three.{}.pdf", None, "")]


@query("src_pdf_meta", f"SELECT path, coalesce(nullif(trim(title), ''), regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^./]+$', '')) AS title, coalesce(nullif(trim(author), ''), 'Unknown') AS author FROM {dealt_sql(META, META_DDL, "path", "id")}")
def _(t):
    raw = dealt(t, META, META_DDL, "path", "id").select("path", F.create_map(F.lit("title"), F.col("title"), F.lit("author"), F.col("author")).alias("info"))
    return files.pdf_metadata(raw).select("path", "title", "author")


_asked = "(SELECT doc_id, trim(text, ' ' || chr(9) || chr(10)) AS text FROM documents)"


@query("stream_requests", f"SELECT doc_id, CASE WHEN length(text) > {requests.LIMIT} THEN left(text, {requests.LIMIT}) || '{requests.MARK}' ELSE text END AS request, CASE WHEN {fx.sql_contains('lower(left(text, ' + str(requests.LIMIT) + '))', requests.SUMMARY_WORDS)} THEN 'summarization' ELSE 'sysadmin' END AS category, CASE WHEN {fx.sql_contains('lower(left(text, ' + str(requests.LIMIT) + '))', requests.SUMMARY_WORDS)} THEN 'summarize' ELSE 'collaborate' END AS handler FROM {_asked} WHERE text <> ''")
def _(t):
    """Each document as a request through the stream, many to a file and one micro-batch after
    another, into a sink that takes each batch once."""
    folder, out, mark = (fresh_path(t.spark, n) for n in ("arrivals", "handled", "offsets"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    t.documents.select(name.alias("name"), F.col("text").alias("request")).write.option("maxRecordsPerFile", 10_000).json(folder)
    stream, sink = requests.triaged(requests.packed(t.spark, folder, per_trigger=16)), BatchSink(t.spark, out)
    requests.run(stream, sink.write, mark).awaitTermination()
    return sink.read(stream.schema).select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("doc_id"), "request", "category", "handler")


@query("sink_pending", "SELECT doc_id, '{\"request_id\":' || doc_id || ',\"status\":\"needs_clarification\"}' AS metadata FROM documents WHERE length(text) < 100")
def _(t):
    held = t.documents.where(F.length("text") < 100)
    return held.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("request_id"), F.lit("needs_clarification").alias("status"))).alias("metadata"))


@query("src_spec_content", "SELECT r.doc_id, CASE WHEN s.doc_id IS NULL THEN 'request ' || r.doc_id ELSE s.text END AS content FROM documents r LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) s USING (doc_id)")
def _(t):
    """The specification's text where its file exists, else the request itself."""
    there = t.documents.where("doc_id % 2 = 0").select("doc_id", "text")
    asked = t.documents.select("doc_id", F.concat(F.lit("request "), F.col("doc_id").cast("string")).alias("request"))
    return asked.join(there, "doc_id", "left").select("doc_id", F.coalesce("text", "request").alias("content"))


STORED = "SELECT chunk_id, doc_id, chunk_number, db, collection, round(embedding[1], 6) AS first, len(embedding) AS dims FROM " + V


def kept(rows):
    return rows.select("chunk_id", "doc_id", "chunk_number", "db", "collection", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").cast("long").alias("dims"))


@query("vec_add", STORED)
def _(t):
    return kept(stored(t).read())


@query("vec_drop_collection", f"{STORED} WHERE NOT (db = 'private' AND collection = 'semantic')")
def _(t):
    store = stored(t)
    store.drop_collection("private", "semantic")
    return kept(store.read())


@query("mem_touch", f"SELECT chunk_id, CASE WHEN chunk_id % 50 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS importance, CASE WHEN chunk_id % 50 = 0 THEN 1 ELSE 0 END AS access_count FROM {V} UNION ALL SELECT -1, 0.8::DOUBLE, 1")
def _(t):
    """Memories of known ids change, of other ids are added; the rest stay."""
    rows = fx.vectors(t).select("chunk_id", "db", "collection", F.lit(0.5).alias("importance"), F.lit(0).alias("access_count"))
    touched = fx.asked(t).select(F.col("query_id").alias("chunk_id"), F.lit(0.9).alias("importance")).unionByName(inline(t, [(-1, 0.8)], "chunk_id long, importance double"))
    return updated(rows, touched).select("chunk_id", "importance", "access_count")


# Every tenth document is read anew with another count, and one more for each is added; documents
# of each seventh id go.
MERGED = f"(SELECT doc_id, title, CASE WHEN doc_id % 10 = 0 THEN total_tokens + 1 ELSE total_tokens END AS total_tokens FROM {fx.CATALOG} UNION ALL SELECT -1 - doc_id, 'added ' || doc_id, 7 FROM documents WHERE doc_id % 10 = 0)"


@query("store_keyed_merge", f"SELECT * FROM {MERGED} WHERE doc_id % 7 <> 3")
def _(t):
    """The catalog as a keyed table, merged with changes and then rid of some documents."""
    rows = fx.catalog(t).select("doc_id", "title", "total_tokens")
    table = KeyedTable(t.spark, "doc_id", buckets=8).create(rows)
    some = rows.where("doc_id % 10 = 0")
    anew = some.select("doc_id", F.lit(None).cast("string").alias("title"), (F.col("total_tokens") + 1).alias("total_tokens"))
    added = some.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("added "), F.col("doc_id").cast("string")).alias("title"), F.lit(7).cast("long").alias("total_tokens"))
    table.merge(anew.unionByName(added))
    table.delete(rows.where("doc_id % 7 = 3").select("doc_id"))
    return table.read()


@query("store_admin_stats")
def _(t):
    return stored(t).stats()


@query("store_reset", f"{STORED} WHERE db = 'public'")
def _(t):
    store = stored(t)
    assert not store.reset("private") and store.reset("private", confirm=True)
    return kept(store.read())


#: Rows with faults for the health checks: ids missing and vectors of two lengths.
BROKEN = f"(SELECT CASE WHEN chunk_id % 50 <> 0 THEN chunk_id END AS chunk_id, db, CASE WHEN chunk_id % 3 = 0 THEN embedding[1:32] ELSE embedding END AS embedding FROM {V})"


def sql_health(rows: str, store: str) -> str:
    one = f"(SELECT count(*) > 0 AS a, count(*) FILTER (chunk_id IS NULL) = 0 AS b, count(DISTINCT db) > 0 AS c, count(*) FILTER (len(embedding) < 1) = 0 AS d, count(DISTINCT len(embedding)) = 1 AS e FROM {rows})"
    return f"SELECT '{store}' AS store, unnest(['has rows', 'ids', 'databases', 'vectors', 'one dimension']) AS \"check\", unnest([a, b, c, d, e]) AS passed FROM {one}"


@query("store_health", f"{sql_health(V, 'sound')} UNION ALL {sql_health(BROKEN, 'broken')}")
def _(t):
    rows = fx.vectors(t)
    broken = rows.withColumn("embedding", F.when(F.col("chunk_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))).withColumn("chunk_id", F.when(F.col("chunk_id") % 50 != 0, F.col("chunk_id")))
    parts = [stored(t, r).health().select(F.lit(name).alias("store"), "check", "passed") for name, r in (("sound", rows), ("broken", broken))]
    return parts[0].unionByName(parts[1])


@query("log_full_response", "SELECT conv_id AS session_id, role AS kind, text FROM conversations")
def _(t):
    """An append-only log of prompts and replies, written twice and read as one."""
    path = fresh_path(t.spark, "log")
    rows = fx.interactions(t).select("session_id", "kind", F.col("input").alias("text"))
    for part in ("kind = 'user'", "kind <> 'user'"):
        rows.where(part).write.mode("append").json(path)
    return t.spark.read.schema("session_id long, kind string, text string").json(path)


@query("cat_add_chapter", f"SELECT DISTINCT doc_id, chunk_number // 2 AS chapter_num, md5(doc_id || ':' || chunk_number // 2) AS chapter_id FROM {V}")
def _(t):
    rows = fx.vectors(t).select("doc_id", F.floor(F.col("chunk_number") / 2).cast("int").alias("chapter_num")).distinct().withColumn("chapter_id", F.md5(F.concat_ws(":", "doc_id", "chapter_num")))
    path = fresh_path(t.spark, "chapters")
    rows.write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("cat_add_chunk_meta", f"SELECT chunk_id, doc_id, chunk_number, false AS has_tables FROM {V}")
def _(t):
    path = fresh_path(t.spark, "chunk-meta")
    fx.vectors(t).select("chunk_id", "doc_id", "chunk_number", F.lit(False).alias("has_tables")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


for _name, _db, _kind, _weight in (("mem_store_episodic", "private", "episodic", 0.5), ("mem_store_semantic", "public", "semantic", 0.7)):

    @query(_name, f"SELECT md5(text) AS chunk_id, text AS content, {_weight}::DOUBLE AS importance, '{_db}' AS db, '{_kind}' AS collection FROM conversations")
    def _(t, db=_db, kind=_kind, weight=_weight):
        rows = fx.interactions(t).select(F.md5("input").alias("chunk_id"), F.col("input").alias("content"), F.lit(weight).alias("importance"), F.lit(db).alias("db"), F.lit(kind).alias("collection"))
        return stored(t, rows).read(db, kind)


_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_COUNTS = f"(SELECT doc_id, [len(list_filter(b, lambda y: y = i))::DOUBLE FOR i IN range({providers.DIMS})] AS c FROM (SELECT doc_id, [('0x' || left(md5(w), 8))::BIGINT % {providers.DIMS} FOR w IN {_WORDS}] AS b FROM documents))"
FEATURES = f"(SELECT doc_id, [round(x / greatest(sqrt(list_dot_product(c, c)), 1e-12), 6) FOR x IN c] AS embedding FROM {_COUNTS})"


def rounded(e):
    return F.transform(e, lambda x: F.round(x, 6))


@query("emb_hash_features", f"SELECT doc_id, embedding FROM {FEATURES}")
def _(t):
    return t.documents.select("doc_id", rounded(providers.hashed(F.col("text"))).alias("embedding"))


@query("emb_one", f"SELECT doc_id, round(sqrt(list_dot_product(embedding, embedding)), 4) AS length, list_max(embedding) AS most FROM {FEATURES}")
def _(t):
    """One text at a time: a blank one is the zero vector, others have unit length."""
    rows = t.documents.select("doc_id", rounded(providers.hashed(F.col("text"))).alias("e"))
    return rows.select("doc_id", F.round(vec.norm(F.col("e")), 4).alias("length"), F.array_max("e").alias("most"))


@query("emb_batch", f"SELECT doc_id, CAST(len(embedding) AS INTEGER) AS dims, embedding FROM {FEATURES}")
def _(t):
    """The same features from an encoder that takes lists of texts."""
    e = providers.batched()(F.col("text"))
    return t.documents.select("doc_id", e.alias("e")).select("doc_id", F.size("e").alias("dims"), rounded(F.col("e")).alias("embedding"))


@query("emb_mini", "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS DOUBLE) AS total FROM documents")
def _(t):
    """The second engine: no unit length, blank texts like any other. Its counts sum to the words."""
    e = providers.hashed(F.col("text"), normalise=False)
    return t.documents.select("doc_id", vec.folded(e).alias("total"))


@query("rerank_cross", f"SELECT query_id, CAST(position AS INTEGER) AS rank, chunk_id, round(rerank, 6) AS score FROM {rerank(NEAREST, 5)}")
def _(t):
    """The nearest ten chunks of each query, ranked anew by a scorer of (question, text)."""
    hits = vec.nearest(fx.vectors(t), fx.asked(t), 10).withColumnRenamed("rank", "position")
    best = vec.reranked(hits, fx.contents(t), fx.intents(t), 5, providers.scored())
    return best.select("query_id", F.col("position").alias("rank"), "chunk_id", F.round("rerank", 6).alias("score"))


@query("cmd_history_search", f"SELECT query_id, rank, 'cmd_' || chunk_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (SELECT q.query_id, v.chunk_id, 1 - list_dot_product(query, embedding) / (sqrt(list_dot_product(query, query)) * sqrt(list_dot_product(embedding, embedding))) AS d FROM {V} v, {fx.ASKED} q WHERE v.chunk_id <> q.query_id AND v.collection = 'episodic')) WHERE rank <= 3")
def _(t):
    history = fx.vectors(t).where("collection = 'episodic'")
    return vec.nearest(history, fx.asked(t), 3, "cosine").select("query_id", "rank", F.concat(F.lit("cmd_"), F.col("chunk_id").cast("string")).alias("id"))


@query("kn_confidence_band", f"SELECT query_id, chunk_id, p, CASE WHEN p > 0.7 THEN 'green' WHEN p > 0.4 THEN 'yellow' ELSE 'red' END AS band, p < 0.5 AS tip FROM (SELECT query_id, chunk_id, round(similarity, 6) AS p FROM {multi(10)})")
def _(t):
    p = F.col("p")
    hits = vec.over_collections(fx.vectors(t), fx.asked(t), 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("p"))
    return hits.select("query_id", "chunk_id", "p", F.when(p > 0.7, "green").when(p > 0.4, "yellow").otherwise("red").alias("band"), (p < 0.5).alias("tip"))


@query("qa_answer", f"SELECT query_id, count(*) AS sources, round(least(1.0, avg(CASE WHEN distance <= 1 THEN 1 - distance ELSE 0 END)), 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r FROM (SELECT q.query_id, v.chunk_id, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(query, embedding)]) AS distance FROM {V} v, {fx.ASKED} q WHERE v.chunk_id <> q.query_id AND v.collection = 'semantic')) WHERE r <= 5 GROUP BY query_id")
def _(t):
    """Five semantic memories of each question, as sources with a confidence."""
    hits = vec.nearest(fx.vectors(t).where("collection = 'semantic'"), fx.asked(t), 5)
    return hits.groupBy("query_id").agg(F.count("*").alias("sources"), F.round(F.least(F.lit(1.0), F.avg(vec.similarity(F.col("distance")))), 6).alias("confidence"))


@query("cp_load", f"SELECT session_id, count(*) AS n, max(number) AS last FROM {fx.INTERACTIONS} GROUP BY session_id")
def _(t):
    points = sess.checkpoints(fx.interactions(t))
    return points.groupBy("session_id").agg(F.max("checkpoint_number").cast("long").alias("n"), F.max("number").alias("last"))


@query("wf_result_dicts", f"SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN command END, 'unknown') AS command, coalesce(CASE WHEN id % 4 > 0 THEN output END, '') AS output, status = 'success' AS success FROM {fx.EXECUTIONS}")
def _(t):
    i = F.col("id")
    return fx.executions(t).select("id", F.coalesce(F.when(i % 3 > 0, F.col("command")), F.lit("unknown")).alias("command"), F.coalesce(F.when(i % 4 > 0, F.col("output")), F.lit("")).alias("output"), (F.col("status") == "success").alias("success"))


_W = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
_PIECES = (
    "SELECT doc_id, t, " + _W.format("t") + " AS n, row_number() OVER (PARTITION BY doc_id ORDER BY p, s) AS i FROM (SELECT doc_id, p, unnest(range(1, len(l) + 1)) AS s, unnest(l) AS t FROM (SELECT doc_id, p, "
    "CASE WHEN " + _W.format("para") + " > 200 THEN list_transform(string_split(para, '. '), lambda x: x || '. ') ELSE [para || chr(10) || chr(10)] END AS l FROM (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS para FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents))))"
)


@query("chunk_smart_para", f"WITH RECURSIVE x AS MATERIALIZED ({_PIECES}), r AS (SELECT doc_id, i, n, 0 AS c FROM x WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, CASE WHEN r.n + x.n <= 200 THEN r.n + x.n ELSE x.n END, CASE WHEN r.n + x.n <= 200 THEN r.c ELSE r.c + 1 END FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = r.i + 1) SELECT doc_id, c AS chunk_number, regexp_replace(string_agg(t, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS chunk FROM r JOIN x USING (doc_id, i) GROUP BY doc_id, c")
def _(t):
    """Greedy packing of paragraphs by word counts, as a fold over them."""
    return t.documents.select("doc_id", F.posexplode(text.packed(F.col("text"), 200)).alias("chunk_number", "chunk"))


CODE_DDL = "id int, reply string"
CODES = [(1, "Here:\n```python\ndef f():\n    return '{}'\n```\nDone"), (2, "no fence"), (3, "```\nx\n```"), (4, "```\n{}\n```\nmore ```\nsecond block {}\n```"), (5, "```python\nopen {}")]


@query("clean_code_block", f"SELECT id, CASE WHEN length(code) > 10 THEN code ELSE trim(reply, ' ' || chr(9) || chr(10)) END AS code FROM (SELECT id, reply, trim(regexp_extract(reply, '(?s)```(?:python)?\\n(.*?)```', 1), ' ' || chr(9) || chr(10)) AS code FROM {dealt_sql(CODES, CODE_DDL, 'reply')})")
def _(t):
    """The fenced block if it is long enough, else the whole reply."""
    rows = dealt(t, CODES, CODE_DDL, "reply")
    code = text.strip(F.regexp_extract("reply", r"(?s)```(?:python)?\n(.*?)```", 1))
    return rows.select("id", F.when(F.length(code) > 10, code).otherwise(text.strip(F.col("reply"))).alias("code"))


CHATTY = [
    (1, "Here's the module:\n\n```python\nimport os\n\n\ndef run():\n    '{}'\n    return os.getcwd()\n```\nThis version includes {}\n1. one\n2. two\n"),
    (2, "Below is {}:\nclass A:\n    name = '{}'\n    # {}\nNote: {}\n    other = 1\n\n# end"),
    (3, "{}"),
    (4, "Text first\n`x = 1`\nfrom a import b\nvalue = '{}'\nExample: {}\nThis version works"),
    (5, "I'll write it:\n```\n{}\n```\nand `{}`"),
    (6, "Explanation: {}\n# only a comment\n\n"),
]


def sql_quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_gone(x: str, p: str, by: str = "") -> str:
    return f"regexp_replace({x}, {sql_quoted(p)}, '{by}', 'g')"


def sql_strip(x: str) -> str:
    return sql_gone(x, r"^\s+|\s+$")


def sql_clean_code(rows: str) -> str:
    """The same as replies.clean_code over rows of (id, reply)."""
    calm, plain, y = "reply", "chosen", sql_strip("x")
    for p in replies.CHATTER:
        calm = sql_gone(calm, "(?is)" + p)
    for p, by in replies.UNFENCED:
        plain = sql_gone(plain, p, by.replace("$", "\\"))
    fenced = "list_filter([" + ", ".join(sql_strip(f"regexp_extract(c, {sql_quoted(p)}, 1)") for p in replies.FENCES) + f"], lambda x: length(x) > {replies.FENCED_LEAST})[1]"
    opens = " OR ".join(f"starts_with({y}, {sql_quoted(o)})" for o in replies.OPENS)
    ends = f"{y} <> '' AND NOT starts_with({y}, '#') AND NOT contains({y}, 'This version')"
    remark = " OR ".join(f"contains(lower({y}), {sql_quoted(r)})" for r in replies.REMARKS)
    lines = f"SELECT id, string_split({plain}, chr(10)) AS l FROM (SELECT id, coalesce({fenced}, c) AS chosen FROM (SELECT id, {sql_gone(calm, '(?i)' + replies.LISTED)} AS c FROM {rows}))"
    rest = f"SELECT id, l[greatest(coalesce(list_position(list_transform(l, lambda x: {opens}), true), 1), 1):] AS rest FROM ({lines})"
    last = f"SELECT id, rest, len(rest) + 1 - coalesce(nullif(list_position(list_reverse(list_transform(rest, lambda x: {ends})), true), 0), 1) AS n FROM ({rest})"
    kept = f"list_filter(rest[:n], lambda x: starts_with({y}, '#') OR NOT ({remark}))"
    return f"SELECT id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS code FROM (SELECT id, {sql_strip(f'array_to_string({kept}, chr(10))')} AS body FROM ({last}))"


@query("clean_code_reply", sql_clean_code(dealt_sql(CHATTY, CODE_DDL, "reply")))
def _(t):
    """The code of a reply with chatter, fences and remarks."""
    return dealt(t, CHATTY, CODE_DDL, "reply").select("id", replies.clean_code(F.col("reply")).alias("code"))
