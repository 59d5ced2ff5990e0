"""Engine tables built from the driver's tables, in Spark and as DuckDB subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import analysis

EXTENSIONS = (".txt", ".md", ".py", ".js", ".json", ".yaml", ".yml", ".log", ".pdf", ".exe")
COLLECTIONS = ("documents", "episodic", "semantic", "private_semantic", "private_episodic")


def pick(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))


def sql_pick(options: tuple[str, ...], at: str) -> str:
    return f"([{', '.join(repr(o) for o in options)}])[CAST({at} AS INTEGER) + 1]"


def files(t) -> DataFrame:
    """One file for each document, its extension dealt by the id."""
    ext = pick(EXTENSIONS, F.col("doc_id") % 10)
    return t.documents.select("doc_id", F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").alias("content"))


FILES = f"(SELECT doc_id, '/docs/' || source || '/' || doc_id || {sql_pick(EXTENSIONS, 'doc_id % 10')} AS path, text AS content FROM documents)"


def catalog(t) -> DataFrame:
    """The document catalog."""
    d = t.documents
    path = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"), analysis.document_type(path, F.col("text")).alias("doc_type"), path.alias("file_path"), F.md5("text").alias("file_hash"), F.col("lang").alias("language"), (F.length("text") / 4).cast("long").alias("total_tokens"))


def sql_contains(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_document_type(path: str, text: str) -> str:
    ext = rf"lower(regexp_extract({path}, '(\.[^./]+)$', 1))"
    head = f"lower(left({text}, 2000))"
    code = ", ".join(f"'{e}'" for e in analysis.CODE_EXTENSIONS)
    return (
        f"CASE WHEN {ext} IN ({code}) THEN 'code' WHEN {ext} = '.log' OR contains(left({text}, 1000), 'ERROR') OR contains(left({text}, 1000), 'INFO') THEN 'log' "
        f"WHEN {sql_contains(head, analysis.BOOK_WORDS)} THEN 'book' WHEN {sql_contains(head, analysis.ARTICLE_WORDS)} THEN 'article' "
        f"WHEN {ext} = '.md' OR contains(upper(regexp_extract({path}, '([^/]*)$', 1)), 'README') THEN 'documentation' ELSE 'other' END"
    )


CATALOG = (
    "(SELECT doc_id, 'doc_' || doc_id AS title, source AS author, " + sql_document_type("'/docs/' || source || '/' || doc_id || '.txt'", "text")
    + " AS doc_type, '/docs/' || source || '/' || doc_id || '.txt' AS file_path, md5(text) AS file_hash, lang AS language, length(text) // 4 AS total_tokens FROM documents)"
)


def vectors(t) -> DataFrame:
    """Stored vector rows: five chunks a document, in five collections and two databases."""
    v = t.embeddings
    doc = F.floor(F.col("vec_id") / 5).cast("long")
    return v.select(F.col("vec_id").alias("chunk_id"), doc.alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_number"), (F.col("label") % 5).cast("int").alias("collection_ord"), pick(COLLECTIONS, F.col("label") % 5).alias("collection"), F.when(doc % 2 == 0, "private").otherwise("public").alias("db"), F.col("embedding").cast("array<double>").alias("embedding"))


VECTORS = (
    f"(SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, CAST(vec_id % 5 AS INTEGER) AS chunk_number, CAST(label % 5 AS INTEGER) AS collection_ord, {sql_pick(COLLECTIONS, 'label % 5')} AS collection, "
    "CASE WHEN (vec_id // 5) % 2 = 0 THEN 'private' ELSE 'public' END AS db, embedding::DOUBLE[] AS embedding FROM embeddings)"
)


def asked(t) -> DataFrame:
    """Query vectors: every row whose id is divisible by 50."""
    return t.embeddings.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))


ASKED = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id % 50 = 0)"


def intents(t) -> DataFrame:
    """The queries with what their questions ask for: some an author (one that nobody
    has among them), some a language, all a chapter; the words come from a document."""
    q = F.col("query_id")
    author = F.when(q % 150 == 0, F.concat(F.lit("SRC"), (F.floor(q / 50) % 5).cast("string"))).when(q % 150 == 50, "nobody")
    words = t.documents.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 300).alias("text"))
    return asked(t).select("query_id", "query", author.alias("author"), F.when(q % 100 == 0, "en").alias("language"), (F.floor(q / 50) % 3).cast("int").alias("chapter")).join(words, "query_id", "left")


INTENTS = (
    "(SELECT query_id, query, CASE WHEN query_id % 150 = 0 THEN 'SRC' || (query_id // 50) % 5 WHEN query_id % 150 = 50 THEN 'nobody' END AS author, CASE WHEN query_id % 100 = 0 THEN 'en' END AS language, "
    f"CAST((query_id // 50) % 3 AS INTEGER) AS chapter, left(d.text, 300) AS text FROM {ASKED} a LEFT JOIN documents d ON d.doc_id = a.query_id)"
)


def contents(t) -> DataFrame:
    """The text of each stored vector row: 400 characters of its document."""
    rows = vectors(t).select("chunk_id", "doc_id", "chunk_number").join(t.documents.select("doc_id", "text"), "doc_id")
    return rows.select("chunk_id", F.substring("text", F.col("chunk_number") * 400 + 1, F.lit(400)).alias("content"))


CONTENTS = f"(SELECT v.chunk_id, substr(d.text, v.chunk_number * 400 + 1, 400) AS content FROM {VECTORS} v JOIN documents d USING (doc_id))"


def executions(t) -> DataFrame:
    """Already-run commands: one row for each event; ten a cycle."""
    e = t.events
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 17 == 0, "blocked").when(F.col("event_id") % 19 == 0, "timeout").otherwise("success")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("ran_at"), F.col("event_type").alias("command"), status.alias("status"), F.col("props").alias("output"), F.col("value").alias("execution_time"), (F.col("event_id") % 5 + 1).cast("int").alias("cycle"))


EXECUTIONS = "(SELECT event_id AS id, user_id AS session_id, ts AS ran_at, event_type AS command, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'blocked' WHEN event_id % 19 = 0 THEN 'timeout' ELSE 'success' END AS status, props AS output, value AS execution_time, CAST(event_id % 5 + 1 AS INTEGER) AS cycle FROM events)"


def interactions(t) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("number"), F.col("role").alias("kind"), F.col("text").alias("input"))


INTERACTIONS = "(SELECT conv_id AS session_id, turn AS number, role AS kind, text AS input FROM conversations)"


def actions(t) -> DataFrame:
    """What users did after each interaction, dealt by the text's length."""
    n = F.length("input")
    kind = F.when(n % 6 == 0, "ROLLBACK").when(n % 6 < 3, "MODIFY").when((n % 6 == 3) & (F.col("number") > 2), "STOP").otherwise("CONTINUE")
    return interactions(t).select("session_id", "number", F.col("kind").alias("stage"), (F.col("kind") != "system").alias("allows"), kind.alias("action"), F.substring("input", 1, 20).alias("value"), (F.floor(n / 6) % 4).cast("long").alias("target"))


ACTIONS = (
    "(SELECT session_id, number, kind AS stage, kind <> 'system' AS allows, CASE WHEN length(input) % 6 = 0 THEN 'ROLLBACK' WHEN length(input) % 6 < 3 THEN 'MODIFY' WHEN length(input) % 6 = 3 AND number > 2 THEN 'STOP' ELSE 'CONTINUE' END AS action, "
    f"left(input, 20) AS value, length(input) // 6 % 4 AS target FROM {INTERACTIONS})"
)
