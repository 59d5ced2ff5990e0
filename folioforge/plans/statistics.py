"""Queries of rollups over already-run commands, memory rules and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import text
from folioforge.operators import summaries as op
from folioforge.operators.running import running
from folioforge.plans.registry import dealt, dealt_sql, query
from folioforge.plans.text import chunk_rows, sql_chunks

E = fx.EXECUTIONS
OK = "sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END)"


def ok():
    return F.count_if(F.col("status") == "success")


@query("agg_running_avg", f"SELECT id, round(avg(execution_time) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING), 9) AS average FROM {E}")
def _(t):
    rows = fx.executions(t).select("session_id", "id", "execution_time", F.when(F.col("execution_time").isNotNull(), 1).alias("one"))
    return running(rows, ["session_id"], ["id"], {"total": "execution_time", "n": "one"}).select("id", F.round(F.when(F.col("n") > 0, F.col("total") / F.col("n")), 9).alias("average"))


@query("agg_agent_stats", f"SELECT command, count(*) AS n, round(sum(execution_time), 4) AS total, round(sum(execution_time) / greatest(1, count(*)), 6) AS average, round({OK}::DOUBLE / greatest(1, count(*)), 6) AS success_rate FROM {E} GROUP BY command")
def _(t):
    n = F.greatest(F.lit(1), F.count("*"))
    return fx.executions(t).groupBy("command").agg(F.count("*").alias("n"), F.round(F.sum("execution_time"), 4).alias("total"), F.round(F.sum("execution_time") / n, 6).alias("average"), F.round(ok() / n, 6).alias("success_rate"))


@query("agg_executor_stats", f"SELECT count(*) AS executed, CAST({OK} AS BIGINT) AS successful, round(sum(execution_time), 3) AS total, round(avg(execution_time), 6) AS average FROM {E}")
def _(t):
    return fx.executions(t).agg(F.count("*").alias("executed"), ok().alias("successful"), F.round(F.sum("execution_time"), 3).alias("total"), F.round(F.avg("execution_time"), 6).alias("average"))


@query("agg_task_summary", f"SELECT session_id, cycle, count(*) AS executed, CAST({OK} AS BIGINT) AS successful, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM {E} GROUP BY session_id, cycle")
def _(t):
    return fx.executions(t).groupBy("session_id", "cycle").agg(F.count("*").alias("executed"), ok().alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("agg_insights", f"SELECT id, left(string_split(output, chr(10))[1], 100) AS insight FROM {E} WHERE status = 'success' AND length(string_split(output, chr(10))[1]) > 8")
def _(t):
    first = F.split("output", "\n")[0]
    return fx.executions(t).where((F.col("status") == "success") & (F.length(first) > 8)).select("id", F.substring(first, 1, 100).alias("insight"))


@query("agg_direct_summary", f"SELECT session_id, CAST({OK} AS BIGINT) || ' of ' || count(*) || ' ran' || CASE WHEN bool_or(command = 'error') THEN '; errors seen' ELSE '' END AS summary FROM {E} GROUP BY session_id")
def _(t):
    errors = F.when(F.bool_or(F.col("command") == "error"), "; errors seen").otherwise("")
    return fx.executions(t).groupBy("session_id").agg(F.concat(ok().cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" ran"), errors).alias("summary"))


@query("agg_summary_stats", "SELECT source, count(*) AS files, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, 1.0::DOUBLE AS rate FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("files"), F.sum(text.tokens(F.col("text"))).alias("tokens"), F.lit(1.0).alias("rate"))


@query("agg_coder_stats", f"SELECT command, round({OK}::DOUBLE / greatest(1, count(*)), 6) AS rate, round(avg(execution_time), 6) AS average FROM {E} WHERE cycle = 1 GROUP BY command")
def _(t):
    return fx.executions(t).where("cycle = 1").groupBy("command").agg(F.round(ok() / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"), F.round(F.avg("execution_time"), 6).alias("average"))


@query("agg_monitor_stats", f"SELECT round({OK}::DOUBLE / greatest(1, count(*)), 6) AS success_rate, round((epoch(max(ran_at)) - epoch(min(ran_at))) / 3600, 4) AS hours FROM {E}")
def _(t):
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return fx.executions(t).agg(F.round(ok() / F.greatest(F.lit(1), F.count("*")), 6).alias("success_rate"), F.round((seconds(F.max("ran_at")) - seconds(F.min("ran_at"))) / 3600, 4).alias("hours"))


@query("agg_kn_stats", f"SELECT (SELECT count(*) FROM {fx.CATALOG}) AS documents, (SELECT count(*) FROM {fx.VECTORS}) AS chunks, count(*) AS tasks FROM {E}")
def _(t):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(fx.catalog(t), "documents").crossJoin(one(fx.vectors(t), "chunks")).crossJoin(one(fx.executions(t), "tasks"))  # one row each


@query("agg_last10", f"SELECT session_id, id, command FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM {E}) WHERE n <= 10")
def _(t):
    return fx.executions(t).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))).where("n <= 10").select("session_id", "id", "command")


@query("agg_cycle_totals", f"SELECT session_id, count(DISTINCT cycle) AS cycles, count(*) AS commands, arg_max(status, id) = 'success' AS complete FROM {E} GROUP BY session_id")
def _(t):
    return fx.executions(t).groupBy("session_id").agg(F.countDistinct("cycle").alias("cycles"), F.count("*").alias("commands"), (F.max_by("status", "id") == "success").alias("complete"))


@query("mem_importance_rule", f"SELECT id, CASE WHEN status = 'success' THEN 0.7 ELSE 0.5 END::DOUBLE AS importance FROM {E}")
def _(t):
    return fx.executions(t).select("id", F.when(F.col("status") == "success", 0.7).otherwise(0.5).alias("importance"))


PREF_DDL = "configured string, session string"
PREFS = [(c, s) for c in ("private", "public", "skip", None) for s in ("private", "public", None)]


@query("mem_save_decision", f"SELECT configured, session, coalesce(session, configured, 'private') AS target FROM {dealt_sql(PREFS, PREF_DDL)}")
def _(t):
    return dealt(t, PREFS, PREF_DDL).select("configured", "session", F.coalesce("session", "configured", F.lit("private")).alias("target"))


@query("mem_debug_context", f"SELECT session_id, string_agg(command || ': ' || status, chr(10) ORDER BY id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM {E}) WHERE n <= 3 GROUP BY session_id")
def _(t):
    rows = fx.executions(t).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where("n <= 3")
    line = F.concat("command", F.lit(": "), "status")
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))).alias("a")).select("session_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("context"))


@query("ctx_exec_results", f"SELECT session_id, cycle, string_agg('- ' || command || ' [' || status || '] ' || left(output, 200), chr(10) ORDER BY id) AS context FROM {E} GROUP BY session_id, cycle")
def _(t):
    """What each cycle of a session ran, for the next one's prompt."""
    line = F.concat(F.lit("- "), "command", F.lit(" ["), "status", F.lit("] "), F.substring("output", 1, 200))
    rows = fx.executions(t).groupBy("session_id", "cycle").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))).alias("a"))
    return rows.select("session_id", "cycle", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("context"))


@query("sum_plan", "SELECT doc_id, length(text) // 4 <= 8192 - 3276 AS direct FROM documents")
def _(t):
    return t.documents.select("doc_id", (text.tokens(F.col("text")) <= 8192 - max(int(8192 * 0.4), 2500)).alias("direct"))


DEPTH_DDL = "depth string"
DEPTHS = [("quick",), ("standard",), ("deep",), ("other",)]


@query("sum_insight_plan", f"SELECT depth, CASE depth WHEN 'quick' THEN '3-5' WHEN 'standard' THEN '5-7' ELSE '7-10' END AS insights, CASE depth WHEN 'quick' THEN 300 WHEN 'standard' THEN 500 ELSE 700 END AS max_tokens FROM {dealt_sql(DEPTHS, DEPTH_DDL)}")
def _(t):
    d = F.col("depth")
    return dealt(t, DEPTHS, DEPTH_DDL).select("depth", F.when(d == "quick", "3-5").when(d == "standard", "5-7").otherwise("7-10").alias("insights"), F.when(d == "quick", 300).when(d == "standard", 500).otherwise(700).alias("max_tokens"))


MAPPED = f"(SELECT doc_id, chunk_number, CASE WHEN length(chunk) <= 200 THEN chunk ELSE left(chunk, 197) || '...' END AS summary FROM ({sql_chunks('documents', 'doc_id', 500, 50)}))"


@query("sum_map", f"SELECT * FROM {MAPPED}")
def _(t):
    return op.mapped(chunk_rows(t.documents, "doc_id", 500, 50))


@query("sum_fold", f"WITH RECURSIVE m AS (SELECT * FROM {MAPPED}), f AS (SELECT doc_id, chunk_number, summary FROM m WHERE chunk_number = 0 UNION ALL SELECT f.doc_id, m.chunk_number, right(f.summary || ' ' || m.summary, 600) FROM f JOIN m ON m.doc_id = f.doc_id AND m.chunk_number = f.chunk_number + 1) SELECT doc_id, arg_max(summary, chunk_number) AS summary FROM f GROUP BY doc_id")
def _(t):
    return op.folded(op.mapped(chunk_rows(t.documents, "doc_id", 500, 50)), 600)


@query("sum_condense", "SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) // 4 <= 300 THEN text ELSE left(text, 1200) END AS condensed FROM documents")
def _(t):
    n = text.tokens(F.col("text"))
    return t.documents.select("doc_id", n.alias("tokens"), F.when(n <= 300, F.col("text")).otherwise(F.substring("text", 1, 1200)).alias("condensed"))


@query("sum_budget", "SELECT doc_id, CASE WHEN n > 6553 THEN 'emergency' WHEN n > 2457 THEN 'limited' ELSE 'whole' END AS plan, least(n, 2457) AS taken FROM (SELECT doc_id, length(text) // 4 AS n FROM documents)")
def _(t):
    n = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.when(n > 6553, "emergency").when(n > 2457, "limited").otherwise("whole").alias("plan"), F.least(n, F.lit(2457)).alias("taken"))


@query("sum_store_rows", f"SELECT m.doc_id, m.chunk_number, count(*) OVER (PARTITION BY m.doc_id) AS total_chunks, left(m.summary, 50) AS chunk_summary, 0.7::DOUBLE AS importance, 'private' AS db FROM {MAPPED} m")
def _(t):
    rows = op.mapped(chunk_rows(t.documents, "doc_id", 500, 50))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    return rows.join(total, "doc_id").select("doc_id", "chunk_number", "total_chunks", F.substring("summary", 1, 50).alias("chunk_summary"), F.lit(0.7).alias("importance"), F.lit("private").alias("db"))


FOLDED = f"(WITH RECURSIVE m AS (SELECT * FROM {MAPPED}), f AS (SELECT doc_id, chunk_number, summary FROM m WHERE chunk_number = 0 UNION ALL SELECT f.doc_id, m.chunk_number, right(f.summary || ' ' || m.summary, 600) FROM f JOIN m ON m.doc_id = f.doc_id AND m.chunk_number = f.chunk_number + 1) SELECT doc_id, arg_max(summary, chunk_number) AS summary FROM f GROUP BY doc_id)"


@query("sum_cached_pipeline", f"SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'cached' ELSE 'made' END AS origin, CASE WHEN d.doc_id % 3 = 0 THEN 'stored ' || d.doc_id ELSE m.summary END AS summary FROM documents d LEFT JOIN {FOLDED} m USING (doc_id)")
def _(t):
    """Stored summaries where path and hash are known; the others are made, and only they
    are chunked, mapped and folded."""
    c = fx.catalog(t).select("doc_id", "file_path", "file_hash")
    cache = c.where("doc_id % 3 = 0").select("file_path", "file_hash", F.concat(F.lit("stored "), F.col("doc_id").cast("string")).alias("summary"))
    hit = c.join(cache, ["file_path", "file_hash"]).select("doc_id", F.lit("cached").alias("origin"), "summary")
    miss = c.join(cache, ["file_path", "file_hash"], "left_anti").select("doc_id")
    made = op.folded(op.mapped(chunk_rows(t.documents.join(miss, "doc_id", "left_semi"), "doc_id", 500, 50)), 600)
    return hit.unionByName(miss.join(made, "doc_id", "left").select("doc_id", F.lit("made").alias("origin"), "summary"))


# Whole texts through a context of 1024 tokens: 0.8 of it less 100 for the prompt and 300 for the reply.
_ROOM = 4 * (int(0.8 * 1024) - 400) + 3
_PIECES = f"(SELECT doc_id, text, n, CASE WHEN n = 0 THEN 1 ELSE 1 << least({op.DEPTH}, CAST(ceil(log2(greatest(n, {_ROOM})::DOUBLE / {_ROOM})) AS INTEGER)) END AS parts FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL))"


@query("sum_split", f"SELECT doc_id, parts AS pieces, (SELECT string_agg(CASE WHEN length(x) <= 200 THEN x ELSE left(x, 197) || '...' END, ' ' ORDER BY i) FROM (SELECT i, substr(text, i * ((n + parts - 1) // parts) + 1, (n + parts - 1) // parts) AS x FROM range(parts) g(i)) WHERE x <> '' OR parts = 1) AS summary FROM {_PIECES}")
def _(t):
    """Texts over the room of a prompt are halved until each piece fits; pieces stay in order."""
    rows = t.documents.where("text IS NOT NULL").select("doc_id", F.lit(0).alias("chunk_number"), F.col("text").alias("chunk"))
    parts = F.size(op.pieces(F.col("chunk"), _ROOM)).cast("long")
    made = op.mapped(rows, context=1024, prompt=100)
    return rows.select("doc_id", parts.alias("pieces")).join(made.select("doc_id", "summary"), "doc_id")


