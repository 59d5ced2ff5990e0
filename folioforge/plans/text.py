"""Queries over text: normalisation, tokens, chunks, sources and document analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import analysis, text
from folioforge.plans.registry import dealt, dealt_sql, query

SQL_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SQL_PARAS = "array_to_string(list_filter(list_transform(string_split(coalesce({0}, ''), chr(10) || chr(10)), lambda p: " + SQL_FLAT.format("p") + "), lambda p: p <> ''), chr(10) || chr(10))"

PARA_DDL = "id int, text string"
PARAS = [
    (1, "one  two\tthree\n\nfour\n five \n\n\n\nsix"),
    (2, "  lead\n\n\n\ntrail  "),
    (3, ""),
    (4, " \n\n \t "),
    (5, None),
    (6, "Sentence one. Sentence two! Sentence three? " * 40),
    (7, "x" * 950),
    (8, "short para\n\n" + "long tail without stops " * 60),
    (9, "A word. " * 30 + "\n\n" + "B word. " * 45),
    (10, "äöü ß é. " * 90),
    (11, "e" * 400),
    (12, "no stops here just words " * 50),
    (13, "line one.\nline two.\n" * 40),
]


@query("txt_norm_flat", f"SELECT doc_id, {SQL_FLAT.format('text')} AS flat FROM documents")
def _(t):
    return t.documents.select("doc_id", text.flat(F.col("text")).alias("flat"))


@query("txt_norm_para", f"SELECT id, {SQL_PARAS.format('text')} AS normal FROM {dealt_sql(PARAS, PARA_DDL, "text")}")
def _(t):
    return dealt(t, PARAS, PARA_DDL, "text").select("id", text.paragraphs(F.col("text")).alias("normal"))


@query("tok_count", f"SELECT doc_id, length(text) // 4 AS tokens, length({SQL_FLAT.format('text')}) // 4 AS flat_tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.tokens(F.col("text")).alias("tokens"), text.tokens(text.flat(F.col("text"))).alias("flat_tokens"))


@query("tok_fits_context", "SELECT doc_id, length(text) // 4 <= 4096 - 1000 AS fits FROM documents")
def _(t):
    return t.documents.select("doc_id", (text.tokens(F.col("text")) <= 4096 - 1000).alias("fits"))


@query("tok_eta", "SELECT doc_id, round(n / 50.0 + CASE WHEN n > 8000 THEN 2 * (n // 3000) ELSE 0 END, 6) AS seconds FROM (SELECT doc_id, length(text) // 4 AS n FROM documents)")
def _(t):
    n = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.round(n / 50 + F.when(n > 8000, 2 * F.floor(n / 3000)).otherwise(0), 6).alias("seconds"))


SIZES = (80, 100, 150, 200, 300, 500)


@query("txt_preview", "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '{'' if n == 100 else '...'}' ELSE text END AS p{n}" for n in SIZES) + " FROM documents")
def _(t):
    return t.documents.select("doc_id", *(text.preview(F.col("text"), n, "" if n == 100 else "...").alias(f"p{n}") for n in SIZES))


@query("txt_fallback_summary", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 497) || '...' END AS summary FROM documents")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.when(F.length(c) <= 500, c).otherwise(F.concat(F.substring(c, 1, 497), F.lit("..."))).alias("summary"))


def sql_rfind(s: str, part: str) -> str:
    """part: a DuckDB expression of the reversed pattern and its length."""
    pattern, n = part, {"chr(10) || chr(10)": 2, "' '": 1}.get(part, 2)
    return f"(CASE WHEN instr(reverse({s}), {pattern}) > 0 THEN length({s}) - instr(reverse({s}), {pattern}) - {n - 1} ELSE -1 END)"


BLANK, SPACE = "chr(10) || chr(10)", "' '"
STOPS = ("' .'", "chr(10) || '.'", "' !'", "' ?'")


def sql_chunks(source: str, key: str, size: int, overlap: int) -> str:
    """Chunks as a recursive query over (key, text)."""
    cpc, back = 4 * size, 4 * overlap
    w = f"substr(s, st + 1, {cpc})"
    blank, space = sql_rfind("w", BLANK), sql_rfind("w", SPACE)
    stop = "greatest(" + ", ".join(sql_rfind("w", x) for x in STOPS) + ")"
    taken = f"CASE WHEN st + {cpc} >= length(s) THEN length(s) - st WHEN {blank} > {cpc * 0.6} THEN {blank} + 2 WHEN {blank} = -1 AND {stop} > {cpc * 0.7} THEN {stop} + 2 WHEN {blank} = -1 AND {space} > {cpc * 0.8} THEN {space} + 1 ELSE {cpc} END"
    return f"""WITH RECURSIVE n AS (SELECT {key} AS k, {SQL_PARAS.format('text')} AS s FROM {source}),
    r AS (SELECT k, s, 0 AS st, 0 AS en, 0 AS i FROM n WHERE length(s) > 0
      UNION ALL
      SELECT k, s, CASE WHEN st + taken >= length(s) THEN length(s) WHEN st + taken - {back} <= st + 10 THEN st + {max(10, cpc // 2)} ELSE st + taken - {back} END, st + taken, i + 1
      FROM (SELECT k, s, st, i, {taken} AS taken FROM (SELECT *, {w} AS w FROM r WHERE st < length(s) AND i < length(s) // {cpc} + 100))),
    c AS (SELECT b.k, b.i, regexp_replace(substr(b.s, a.st + 1, b.en - a.st), '^\\s+|\\s+$', '', 'g') AS chunk FROM r a JOIN r b ON a.k = b.k AND b.i = a.i + 1)
    SELECT k AS {key}, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS chunk_number, chunk FROM c WHERE chunk <> ''"""


def chunk_rows(df, key: str, size: int, overlap: int):
    normal = df.select(key, text.paragraphs(F.col("text")).alias("s"))
    return normal.select(key, F.posexplode(text.chunks(F.col("s"), size, overlap)).alias("chunk_number", "chunk"))


@query("chunk_estimate", sql_chunks("documents", "doc_id", 500, 50))
def _(t):
    return chunk_rows(t.documents, "doc_id", 500, 50)


@query("chunk_semantic", sql_chunks("documents", "doc_id", 3000, 200))
def _(t):
    return chunk_rows(t.documents, "doc_id", 3000, 200)


@query("chunk_paragraph_rule", sql_chunks(dealt_sql(PARAS, PARA_DDL, "text"), "id", 100, 10))
def _(t):
    return chunk_rows(dealt(t, PARAS, PARA_DDL, "text"), "id", 100, 10)


TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query("chunk_fixed_tokens", f"SELECT doc_id, CAST(k AS INTEGER) AS chunk_number, array_to_string(w[k * 90 + 1:k * 90 + 100], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 100) / 90), 0) AS BIGINT))) AS k FROM (SELECT doc_id, {TOKENS} AS w FROM documents) WHERE len(w) > 0)")
def _(t):
    """Runs of 100 tokens, ten of them shared with the run before."""
    words = F.filter(F.split("text", text.SPACES), lambda w: w != "")
    rows = t.documents.select("doc_id", F.posexplode(text.token_chunks(words, 100, 10)).alias("chunk_number", "c"))
    return rows.select("doc_id", "chunk_number", F.array_join("c", " ").alias("chunk"))


def sql_break(target: str) -> str:
    stop = "greatest(" + ", ".join(sql_rfind("p", x) for x in STOPS) + ")"
    b, sp = sql_rfind("p", BLANK), sql_rfind("p", SPACE)
    return f"CASE WHEN {b} >= 0 THEN st + {b} + 2 WHEN {stop} >= 0 THEN st + {stop} + 2 WHEN {sp} >= 0 THEN st + {sp} + 1 ELSE {target} END"


@query("chunk_break_point", f"SELECT doc_id, CAST({sql_break('1000')} AS INTEGER) AS at FROM (SELECT doc_id, 800 AS st, substr(text, 801, greatest(least(length(text), 1200) - 800, 0)) AS p FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.break_point(F.col("text"), F.lit(1000)).cast("int").alias("at"))


def checked(rows, key: str):
    """Diagnostics of each key's list of chunks."""
    n = text.tokens(F.col("chunk"))
    blank = F.trim("chunk") == ""
    return rows.groupBy(key).agg((F.sum(blank.cast("int")) == 0).alias("valid"), F.count("*").alias("chunk_count"), F.sum(blank.cast("long")).alias("empty_chunks"), F.sum(F.when(~blank, n).otherwise(0)).alias("total_tokens"), F.round(F.coalesce(F.avg(F.when(~blank, n)), F.lit(0.0)), 6).alias("avg_tokens"), F.sum((~blank & (n < 50)).cast("long")).alias("small_chunks"))


@query("chunk_integrity", f"SELECT doc_id, bool_and(trim(chunk) <> '') AS valid, count(*) AS chunk_count, CAST(sum(CASE WHEN trim(chunk) = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_chunks, CAST(sum(CASE WHEN trim(chunk) <> '' THEN length(chunk) // 4 ELSE 0 END) AS BIGINT) AS total_tokens, round(coalesce(avg(CASE WHEN trim(chunk) <> '' THEN length(chunk) // 4 END), 0), 6) AS avg_tokens, CAST(sum(CASE WHEN trim(chunk) <> '' AND length(chunk) // 4 < 50 THEN 1 ELSE 0 END) AS BIGINT) AS small_chunks FROM ({sql_chunks('documents', 'doc_id', 500, 50)}) GROUP BY doc_id")
def _(t):
    return checked(chunk_rows(t.documents, "doc_id", 500, 50), "doc_id")


@query("doc_total_tokens", f"SELECT doc_id, CAST(sum(length(chunk) // 4) AS BIGINT) AS total_tokens FROM ({sql_chunks('documents', 'doc_id', 500, 50)}) GROUP BY doc_id")
def _(t):
    return chunk_rows(t.documents, "doc_id", 500, 50).groupBy("doc_id").agg(F.sum(text.tokens(F.col("chunk"))).alias("total_tokens"))


def indexed(t):
    """The rows that ingest stores for each chunk, without its clock."""
    rows = chunk_rows(t.documents, "doc_id", 500, 50)
    path = F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = analysis.document_id(path)
    return rows.select(F.concat(name, F.lit("_chunk_"), F.col("chunk_number").cast("string")).alias("chunk_id"), name.alias("doc"), "chunk_number", path.alias("file_path"), analysis.file_name(path).alias("file_name"), text.tokens(F.col("chunk")).alias("token_count"), analysis.has_code(F.col("chunk")).alias("has_code"), F.col("chunk").alias("content"))


_doc = "'doc_' || doc_id || '_' || left(md5('/docs/' || doc_id || '.txt'), 8)"


@query("idx_chunk_rows", f"SELECT {_doc} || '_chunk_' || chunk_number AS chunk_id, {_doc} AS doc, chunk_number, '/docs/' || doc_id || '.txt' AS file_path, doc_id || '.txt' AS file_name, length(chunk) // 4 AS token_count, {fx.sql_contains('chunk', analysis.CODE_MARKS)} AS has_code, chunk AS content FROM ({sql_chunks('documents', 'doc_id', 500, 50)})")
def _(t):
    return indexed(t)


SQL_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
SUPPORTED = ", ".join(f"'{e}'" for e in analysis.SUPPORTED)


@query("src_ext_filter", f"SELECT doc_id, path FROM {fx.FILES} WHERE {SQL_EXT} IN ({SUPPORTED})")
def _(t):
    return fx.files(t).where(analysis.extension(F.col("path")).isin(*analysis.SUPPORTED)).select("doc_id", "path")


@query("src_dir_scan", f"SELECT path, row_number() OVER (ORDER BY list_position([{SUPPORTED}], {SQL_EXT}), path) AS position FROM {fx.FILES} WHERE {SQL_EXT} IN ({SUPPORTED})")
def _(t):
    """Extension by extension, then by path. Numbered per extension, shifted by the counts before."""
    from pyspark.sql import Window

    ext = analysis.extension(F.col("path"))
    known = fx.files(t).withColumn("e", F.array_position(F.array(*map(F.lit, analysis.SUPPORTED)), ext)).where("e > 0")
    counts = known.groupBy("e").agg(F.count("*").alias("n"))  # one row for each extension
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("e").orderBy("path"))
    return known.join(F.broadcast(before.select("e", "before")), "e").select("path", (F.col("before") + rank).alias("position"))


@query("src_summary_loader", f"SELECT doc_id, md5(content) AS file_hash, length(content) AS n FROM {fx.FILES} WHERE {SQL_EXT} IN ('.pdf', '.txt', '.md', '.markdown')")
def _(t):
    return fx.files(t).where(analysis.extension(F.col("path")).isin(*analysis.LOADABLE)).select("doc_id", F.md5("content").alias("file_hash"), F.length("content").cast("long").alias("n"))


CUT = "...[truncated]"


@query("src_request_file", f"SELECT doc_id, CASE WHEN s = '' THEN NULL WHEN length(s) > 2000 THEN left(s, 2000) || '{CUT}' ELSE s END AS request FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)")
def _(t):
    s = text.strip(F.col("text"))
    return t.documents.select("doc_id", F.when(s == "", None).otherwise(text.preview(s, 2000, CUT)).alias("request"))


@query("sink_archive_name", f"SELECT doc_id, '20240131_120000_completed_' || left(md5(path), 8) || '_' || regexp_extract(path, '([^/]*)$', 1) AS archive, '20240131_120000_completed_' || left(md5(path), 8) || '_results.json' AS results FROM {fx.FILES}")
def _(t):
    request = F.substring(F.md5("path"), 1, 8)
    head = F.concat(F.lit("20240131_120000_completed_"), request, F.lit("_"))
    return fx.files(t).select("doc_id", F.concat(head, analysis.file_name(F.col("path"))).alias("archive"), F.concat(head, F.lit("results.json")).alias("results"))


@query("doc_make_id", r"SELECT doc_id, 'doc_' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^./]+$', '') || '_' || left(md5(path), 8) AS made FROM " + fx.FILES)
def _(t):
    return fx.files(t).select("doc_id", analysis.document_id(F.col("path")).alias("made"))


@query("doc_content_hash", "SELECT doc_id, md5(text) AS file_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("file_hash"))


@query("doc_detect_code", f"SELECT doc_id, {fx.sql_contains('text', analysis.CODE_MARKS)} AS has_code FROM documents")
def _(t):
    return t.documents.select("doc_id", analysis.has_code(F.col("text")).alias("has_code"))


@query("doc_detect_type", f"SELECT doc_id, {fx.sql_document_type('path', 'content')} AS doc_type FROM {fx.FILES}")
def _(t):
    return fx.files(t).select("doc_id", analysis.document_type(F.col("path"), F.col("content")).alias("doc_type"))


# Marks of code and of mathematics.
CODE5, MATH = ("def ", "class ", "import ", "function", "var "), ("$$", "\\begin{", "\\frac", "\\sum")
STRUCTURED_DDL = "id int, path string, text string"
STRUCTURED = [
    (1, "/d/a.txt", "Chapter 1: Start\nwords\nChapter 2: Middle.\nmore\nChapter 1: Start\nend"),
    (2, "/d/b.md", "1. Introduction\ntext\n2. Methods...\n3. Results"),
    (3, "/d/c.txt", "Part 1: One\nSection 2: Two\n0x1FIntro here\nCHAPTER 9: LOUD"),
    (4, "/d/d.py", "def f():\n  return 1"),
    (5, "/d/README", "hello $$x$$ there"),
    (6, "/d/e.txt", "ERROR first line\nINFO second"),
    (7, "/d/f.txt", "An abstract of this\nwith a table of contents"),
    (8, "/d/g.txt", ""),
    (9, "/var/log/x.txt", "plain \\frac words"),
    (10, "/d/h.log", "nothing"),
    (11, "/d/i.txt", "text Chapter 3: Inline title.\nSection 3: Inline title"),
    (12, "/d/j.GO", "package main"),
]


@query("doc_flags_head", f"SELECT id, {fx.sql_contains('left(text, 1000)', CODE5)} AS has_code, {fx.sql_contains('text', MATH)} AS has_math, CASE WHEN {SQL_EXT} IN ('.py', '.js', '.java', '.cpp', '.c') THEN 'code' WHEN {SQL_EXT} = '.log' OR contains(lower(path), 'log') THEN 'log' ELSE 'document' END AS kind FROM {dealt_sql(STRUCTURED, STRUCTURED_DDL, "text")}")
def _(t):
    ext = analysis.extension(F.col("path"))
    kind = F.when(ext.isin(".py", ".js", ".java", ".cpp", ".c"), "code").when((ext == ".log") | F.contains(F.lower("path"), F.lit("log")), "log").otherwise("document")
    return dealt(t, STRUCTURED, STRUCTURED_DDL, "text").select("id", analysis.any_of(F.substring("text", 1, 1000), CODE5).alias("has_code"), analysis.any_of(F.col("text"), MATH).alias("has_math"), kind.alias("kind"))


@query("doc_structured_type", f"SELECT id, {fx.sql_document_type('path', 'text')} AS doc_type, {fx.sql_contains('text', analysis.CODE_MARKS)} AS has_code FROM {dealt_sql(STRUCTURED, STRUCTURED_DDL, "text")}")
def _(t):
    return dealt(t, STRUCTURED, STRUCTURED_DDL, "text").select("id", analysis.document_type(F.col("path"), F.col("text")).alias("doc_type"), analysis.has_code(F.col("text")).alias("has_code"))


# Chapter headings, tried in this order.
HEADINGS = (r"Chapter\s+(\d+)[:\s]+(.+?)(?:\n|$)", r"CHAPTER\s+(\d+)[:\s]+(.+?)(?:\n|$)", r"Part\s+(\d+)[:\s]+(.+?)(?:\n|$)", r"Section\s+(\d+)[:\s]+(.+?)(?:\n|$)", r"^(\d+)\.\s+(.+?)(?:\n|$)", r"(0x[0-9a-fA-F]+)([A-Z].+?)(?:\n|$)")


def chapters(df, key: str):
    """(key, number, title, n) of each chapter: one of a number and title, by first place."""
    from pyspark.sql import Window

    found = []
    for k, p in enumerate(HEADINGS):
        p = "(?m)" + p
        rows = df.select(key, "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({p})"), 1)).alias("i", "m"))
        rows = rows.select(key, F.lit(k).alias("k"), "i", F.regexp_extract("m", p, 1).alias("number"), F.regexp_replace(text.strip(F.regexp_extract("m", p, 2)), r"\.+$", "").alias("title"), F.instr("text", F.col("m")).alias("at"))
        found.append(rows)
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    first = Window.partitionBy(key, "number", "title").orderBy("k", "i")
    order = Window.partitionBy(key).orderBy("at", "k", "i")
    kept = every.withColumn("r", F.row_number().over(first)).where("r = 1")
    return kept.select(key, "number", "title", (F.row_number().over(order) - 1).alias("n"))


def sql_headings() -> str:
    each = []
    for k, p in enumerate(HEADINGS):
        q = "'(?m)" + p.replace("'", "''") + "'"
        each.append(f"SELECT id, {k} AS k, i, regexp_extract(m, {q}, 1) AS number, regexp_replace(regexp_replace(regexp_extract(m, {q}, 2), '^\\s+|\\s+$', '', 'g'), '\\.+$', '') AS title, instr(text, m) AS place FROM (SELECT id, text, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS m FROM (SELECT id, text, regexp_extract_all(text, {q}) AS l FROM {dealt_sql(STRUCTURED, STRUCTURED_DDL, "text")}))")
    return " UNION ALL ".join(each)


@query("doc_detect_chapters", f"SELECT id, number, title, CAST(row_number() OVER (PARTITION BY id ORDER BY place, k, i) - 1 AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id, number, title ORDER BY k, i) AS r FROM ({sql_headings()})) WHERE r = 1")
def _(t):
    return chapters(dealt(t, STRUCTURED, STRUCTURED_DDL, "text"), "id")


@query("doc_assign_chapter", f"SELECT chunk_id, m, (chunk_number * m) // n AS chapter FROM (SELECT chunk_id, chunk_number, count(*) OVER (PARTITION BY doc_id) AS n, unnest([1, 3, 5, 8]) AS m FROM {fx.VECTORS})")
def _(t):
    """Chunk i of n of each document to chapter of m by proportion, for documents of 1, 3, 5 and 8 chapters."""
    rows = fx.vectors(t).select("chunk_id", "doc_id", "chunk_number")
    sized = rows.join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").select("chunk_id", "chunk_number", "n", F.explode(F.array(*map(F.lit, (1, 3, 5, 8)))).alias("m"))
    return sized.select("chunk_id", "m", F.floor(F.col("chunk_number") * F.col("m") / F.col("n")).cast("long").alias("chapter"))


@query("doc_chapter_spans", f"SELECT doc_id, CAST((chunk_number * 3) // n AS BIGINT) AS chapter, min(chunk_number) AS first_chunk, max(chunk_number) AS last_chunk FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({sql_chunks('documents', 'doc_id', 500, 50)})) GROUP BY ALL")
def _(t):
    rows = chunk_rows(t.documents, "doc_id", 500, 50)
    sized = rows.select("doc_id", "chunk_number").join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    return sized.groupBy("doc_id", F.floor(F.col("chunk_number") * 3 / F.col("n")).cast("long").alias("chapter")).agg(F.min("chunk_number").alias("first_chunk"), F.max("chunk_number").alias("last_chunk"))


LOOKS = ("def ", "class ", "function ", "import ", "from ", "const ", "var ", "let ", "{", "}")


@query("ui_looks_like_code", f"SELECT doc_id, {fx.sql_contains('text', LOOKS)} AS looks FROM documents")
def _(t):
    return t.documents.select("doc_id", analysis.any_of(F.col("text"), LOOKS).alias("looks"))


@query("idx_outcomes", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN {SQL_EXT} NOT IN ({SUPPORTED}) THEN 'error' WHEN row_number() OVER (PARTITION BY md5(content) ORDER BY doc_id) > 1 THEN 'skipped' ELSE 'success' END AS outcome FROM {fx.FILES}) GROUP BY outcome")
def _(t):
    """Files that a folder run indexes, skips (content seen before) and refuses."""
    first = fx.files(t).groupBy(F.md5("content").alias("h")).agg(F.min("doc_id").alias("first"))
    rows = fx.files(t).withColumn("h", F.md5("content")).join(first, "h")
    outcome = F.when(~analysis.extension(F.col("path")).isin(*analysis.SUPPORTED), "error").when(F.col("doc_id") > F.col("first"), "skipped").otherwise("success")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("idx_dedupe_check", f"SELECT n.doc_id FROM {fx.CATALOG} n WHERE NOT EXISTS (SELECT 1 FROM {fx.CATALOG} o WHERE o.doc_id % 3 = 0 AND o.file_path = n.file_path AND o.file_hash = n.file_hash)")
def _(t):
    """Files to index: those whose path and hash aren't in the catalog (here, every third)."""
    known = fx.catalog(t).where("doc_id % 3 = 0").select("file_path", "file_hash")
    return fx.catalog(t).join(known, ["file_path", "file_hash"], "left_anti").select("doc_id")
