"""Queries of sessions, checkpoints and workflow routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge import fixtures as fx
from folioforge.functions import safety as sf
from folioforge.operators import catalog as cat
from folioforge.operators import sessions as op
from folioforge.operators.running import running
from folioforge.plans.registry import dealt, dealt_sql, query
from folioforge.session import fresh_path
from folioforge.streaming import sessions as stream
from folioforge.streaming.sinks import BatchSink

I = fx.INTERACTIONS  # noqa: E741
E = fx.EXECUTIONS
CP = f"(SELECT *, lag(checkpoint_id) OVER (PARTITION BY session_id ORDER BY number) AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY number) AS checkpoint_number, left(md5(session_id || ':' || number), 12) AS checkpoint_id, kind <> 'system' AS can_rollback FROM {I}))"


@query("sess_upsert", f"SELECT session_id, max(number) AS number, arg_max(kind, number) AS kind FROM {I} GROUP BY session_id")
def _(t):
    return cat.latest(fx.interactions(t).select("session_id", "number", "kind"), ["session_id"], "number")


@query("sess_load", f"SELECT session_id, count(*) AS n, string_agg(checkpoint_id, ',' ORDER BY checkpoint_number) AS checkpoints FROM {CP} GROUP BY session_id")
def _(t):
    points = op.checkpoints(fx.interactions(t))
    rows = points.groupBy("session_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("checkpoint_number", "checkpoint_id"))).alias("l"))
    return rows.select("session_id", "n", F.array_join(F.transform("l", lambda x: x["checkpoint_id"]), ",").alias("checkpoints"))


@query("cp_create", f"SELECT session_id, checkpoint_number, checkpoint_id, parent_id, can_rollback FROM {CP}")
def _(t):
    return op.checkpoints(fx.interactions(t)).select("session_id", "checkpoint_number", "checkpoint_id", "parent_id", "can_rollback")


@query("cp_upsert", f"SELECT session_id, checkpoint_number, checkpoint_id FROM {CP}")
def _(t):
    return op.checkpoints(fx.interactions(t)).select("session_id", "checkpoint_number", "checkpoint_id")


@query("cp_rollback", f"SELECT p.session_id, p.checkpoint_number FROM {CP} p JOIN (SELECT session_id FROM {CP} WHERE checkpoint_number = 2 AND can_rollback) a USING (session_id) WHERE p.checkpoint_number <= 2")
def _(t):
    points = op.checkpoints(fx.interactions(t))
    targets = points.select("session_id").distinct().withColumn("target", F.lit(2))
    return op.rolled_back(points, targets).select("session_id", "checkpoint_number")


@query("cp_chain", f"WITH RECURSIVE p AS (SELECT * FROM {CP}), c AS (SELECT session_id, checkpoint_id, parent_id, 0 AS depth FROM p WHERE parent_id IS NULL UNION ALL SELECT p.session_id, p.checkpoint_id, p.parent_id, c.depth + 1 FROM p JOIN c ON p.parent_id = c.checkpoint_id AND p.session_id = c.session_id) SELECT session_id, checkpoint_id, depth FROM c")
def _(t):
    return op.depths(op.checkpoints(fx.interactions(t)))


@query("cp_summary", f"SELECT session_id, count(*) AS checkpoints, count(DISTINCT kind) AS kinds, CAST(sum(CASE WHEN can_rollback THEN 1 ELSE 0 END) AS BIGINT) AS open FROM {CP} GROUP BY session_id")
def _(t):
    return op.checkpoints(fx.interactions(t)).groupBy("session_id").agg(F.count("*").alias("checkpoints"), F.countDistinct("kind").alias("kinds"), F.count_if("can_rollback").alias("open"))


FREQ = [(f, s) for f in ("none", "minimal", "detailed", "standard", "smart") for s in ("triage", "security", "execution", "execution_complete", "completion_review", "error", "knowledge_query", "final_completion", "other")]
FREQ_DDL = "frequency string, stage string"
_in = lambda w: ", ".join(f"'{x}'" for x in w)


@query("cp_should_create", f"SELECT frequency, stage, CASE frequency WHEN 'none' THEN stage = 'final_completion' WHEN 'minimal' THEN stage IN ({_in(op.CRITICAL)}) WHEN 'detailed' THEN true ELSE stage IN ({_in(op.MAJOR)}) END AS wanted FROM {dealt_sql(FREQ, FREQ_DDL)}")
def _(t):
    return dealt(t, FREQ, FREQ_DDL).select("frequency", "stage", op.wants_checkpoint(F.col("frequency"), F.col("stage")).alias("wanted"))


@query("sess_list", f"SELECT session_id, max(number) AS last FROM {I} GROUP BY session_id ORDER BY last DESC, session_id LIMIT 50")
def _(t):
    return fx.interactions(t).groupBy("session_id").agg(F.max("number").alias("last")).orderBy(F.desc("last"), "session_id").limit(50)


@query("sess_delete", f"SELECT session_id, number FROM {I} WHERE session_id % 4 <> 0")
def _(t):
    gone = fx.interactions(t).where("session_id % 4 = 0").select("session_id").distinct()
    return fx.interactions(t).join(gone, "session_id", "left_anti").select("session_id", "number")


@query("sess_stats", f"SELECT count(DISTINCT session_id) AS sessions, count(*) AS interactions, CAST(sum(length(input)) AS BIGINT) AS size FROM {I}")
def _(t):
    return fx.interactions(t).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("interactions"), F.sum(F.length("input")).alias("size"))


@query("sess_time_rollup", f"SELECT id, session_id, round(sum(execution_time) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM {E}")
def _(t):
    rows = fx.executions(t).select("session_id", "id", "execution_time")
    return running(rows, ["session_id"], ["id"], {"total": "execution_time"}).select("id", "session_id", F.round("total", 4).alias("so_far"))


@query("sess_roundtrip", f"SELECT session_id, number, kind, input FROM {I}")
def _(t):
    """Rows to JSON and back."""
    packed = fx.interactions(t).select(F.to_json(F.struct("session_id", "number", "kind", "input")).alias("j"))
    return packed.select(F.from_json("j", "session_id long, number long, kind string, input string").alias("r")).select("r.*")


# Each row of a session in order: its checkpoint goes on the stack, then the user's action.
REPLAYED = f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY number) AS n FROM {fx.ACTIONS}),
r AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, false AS ended, CAST(NULL AS VARCHAR) AS request, CAST(0 AS BIGINT) AS rollbacks, CAST(0 AS BIGINT) AS refused, CAST([] AS BIGINT[]) AS numbers, CAST([] AS VARCHAR[]) AS stages, CAST([] AS BOOLEAN[]) AS opens FROM a
  UNION ALL SELECT session_id, n, ended OR action = 'STOP', CASE WHEN NOT ended AND action = 'MODIFY' AND value <> '' THEN value ELSE request END, rollbacks + CAST(back AS BIGINT), refused + CAST(NOT ended AND action = 'ROLLBACK' AND NOT back AS BIGINT),
    CASE WHEN back THEN numbers[1:target] ELSE numbers END, CASE WHEN back THEN stages[1:target] ELSE stages END, CASE WHEN back THEN opens[1:target] ELSE opens END
  FROM (SELECT *, NOT ended AND action = 'ROLLBACK' AND target BETWEEN 1 AND len(numbers) AND coalesce(opens[target], false) AS back
    FROM (SELECT r.session_id, a.n, r.ended, r.request, r.rollbacks, r.refused, a.action, a.value, a.target, CASE WHEN r.ended THEN numbers ELSE list_append(numbers, a.number) END AS numbers, CASE WHEN r.ended THEN stages ELSE list_append(stages, a.stage) END AS stages, CASE WHEN r.ended THEN opens ELSE list_append(opens, a.allows) END AS opens
      FROM r JOIN a ON a.session_id = r.session_id AND a.n = r.n + 1)))
SELECT session_id, ended, request, rollbacks, refused, CAST(len(numbers) AS BIGINT) AS checkpoints, stages[-1] AS stage, numbers[-1] AS cycle, array_to_string(numbers, ',') AS history
FROM r WHERE n = (SELECT max(n) FROM a WHERE a.session_id = r.session_id)
"""


@query("wf_apply_action", REPLAYED)
def _(t):
    """Sessions after all actions: STOP, MODIFY, and ROLLBACK to a checkpoint's snapshot."""
    return op.replayed(fx.actions(t))


@query("stream_sessions", REPLAYED)
def _(t):
    """The same from a stream: files in no order, two a micro-batch, states in a sink that
    takes each batch once."""
    folder, out, mark = (fresh_path(t.spark, n) for n in ("actions", "states", "offsets"))
    fx.actions(t).repartition(6).write.json(folder)
    sink = BatchSink(t.spark, out)
    stream.run(stream.arriving(t.spark, folder, 2), sink, mark).awaitTermination()
    return stream.current(sink)


@query("sess_interactions", f"SELECT session_id, number, kind, length(input) AS n FROM {I}")
def _(t):
    return fx.interactions(t).select("session_id", "number", "kind", F.length("input").cast("long").alias("n"))


# Routing.
CAT_DDL = "category string"
CATS = [(c,) for c in (*sf.CATEGORIES, "nonsense")]
AGENTS = {"security": "security", "coding": "coder", "summarization": "summarization", "knowledge_query": "knowledge", "content": "summarization"}
CV = dealt_sql(CATS, CAT_DDL)
_agent = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AGENTS.items()) + " ELSE 'executor' END"


@query("wf_agent_map", f"SELECT category, {_agent} AS agent FROM {CV}")
def _(t):
    table = F.create_map(*(F.lit(x) for kv in AGENTS.items() for x in kv))
    return dealt(t, CATS, CAT_DDL).select("category", F.coalesce(F.try_element_at(table, F.col("category")), F.lit("executor")).alias("agent"))


@query("wf_terminal", f"SELECT category, category IN ({_in(sf.TERMINAL)}) AS is_terminal FROM {CV}")
def _(t):
    return dealt(t, CATS, CAT_DDL).select("category", F.col("category").isin(*sf.TERMINAL).alias("is_terminal"))


@query("wf_route", f"SELECT category, CASE WHEN category IN ({_in(sf.TERMINAL)}) THEN category ELSE 'security>execution>review' END AS stages FROM {CV}")
def _(t):
    c = F.col("category")
    stages = F.when(c.isin(*sf.TERMINAL), F.array(c)).otherwise(F.array(F.lit("security"), F.lit("execution"), F.lit("review")))
    return dealt(t, CATS, CAT_DDL).select("category", F.array_join(stages, ">").alias("stages"))


@query("wf_file_route", f"SELECT category, CASE category WHEN 'summarization' THEN 'summarize' WHEN 'coding' THEN 'generate' WHEN 'knowledge_query' THEN 'answer' ELSE 'collaborate' END AS handler FROM {CV}")
def _(t):
    c = F.col("category")
    return dealt(t, CATS, CAT_DDL).select("category", F.when(c == "summarization", "summarize").when(c == "coding", "generate").when(c == "knowledge_query", "answer").otherwise("collaborate").alias("handler"))


@query("wf_cycle_limit", f"SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n, coalesce(max(CASE WHEN command = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM {E}) WHERE n <= 5 AND done = 0")
def _(t):
    """Cycles up to the first complete one, five at most."""
    order = Window.partitionBy("session_id").orderBy("id")
    done = F.max((F.col("command") == "purchase").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = fx.executions(t).withColumn("n", F.row_number().over(order)).withColumn("done", F.coalesce(done, F.lit(0)))
    return rows.where("n <= 5 AND done = 0").select("id", "session_id")


# Words of next steps that ask for another cycle.
MORE = ("continue", "next", "follow", "more", "additional", "investigate")
NEXT_DDL = "status string, next_steps string, failed int"
NEXTS = [("completed", "Investigate further", 0), ("completed", "done", 2), ("completed", "done", 0), ("failed", "continue", 3), ("completed", "", 0), ("completed", "No MORE work", 0)]


@query("wf_needs_more", f"SELECT status, next_steps, failed, status = 'completed' AND ({' OR '.join(f'contains(lower(next_steps), {chr(39)}{w}{chr(39)})' for w in MORE)} OR failed > 0) AS more FROM {dealt_sql(NEXTS, NEXT_DDL, "next_steps")}")
def _(t):
    more = (F.col("status") == "completed") & (sf.any_of(F.lower("next_steps"), MORE) | (F.col("failed") > 0))
    return dealt(t, NEXTS, NEXT_DDL, "next_steps").select("*", more.alias("more"))


@query("wf_stall", f"SELECT session_id, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) = 0 AND count(*) > 0 AS stalled FROM {E} GROUP BY session_id")
def _(t):
    return fx.executions(t).groupBy("session_id").agg(((F.count_if(F.col("status") == "success") == 0) & (F.count("*") > 0)).alias("stalled"))


@query("wf_input_needed", f"SELECT session_id, cycle, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 2 OR cycle >= 4 AS needed FROM {E} GROUP BY session_id, cycle")
def _(t):
    return fx.executions(t).groupBy("session_id", "cycle").agg(((F.count_if(F.col("status") == "failed") > 2) | (F.first("cycle") >= 4)).alias("needed"))


# Questions about a session.
ASK_DDL = "id int, q string"
ASKS = list(enumerate(["How many commands ran?", "what happened then", "What did it do", "why so", "any error there", "Did it fail", "tell me a tale", "how many"], 1))


@query("sess_qa_router", f"SELECT id, CASE WHEN contains(l, 'how many') AND contains(l, 'command') THEN 'count' WHEN contains(l, 'what did') OR contains(l, 'what happened') THEN 'stages' WHEN contains(l, 'why') THEN 'triage' WHEN contains(l, 'error') OR contains(l, 'fail') THEN 'errors' ELSE 'search' END AS answer FROM (SELECT id, lower(q) AS l FROM {dealt_sql(ASKS, ASK_DDL, "q")})")
def _(t):
    low = F.lower("q")
    has = lambda *w: sf.any_of(low, w)
    return dealt(t, ASKS, ASK_DDL, "q").select("id", F.when(has("how many") & has("command"), "count").when(has("what did", "what happened"), "stages").when(has("why"), "triage").when(has("error", "fail"), "errors").otherwise("search").alias("answer"))


@query("sess_qa_stages", f"SELECT session_id, string_agg(kind, ' -> ' ORDER BY first) AS stages FROM (SELECT session_id, kind, min(number) AS first FROM {I} GROUP BY ALL) GROUP BY session_id")
def _(t):
    first = fx.interactions(t).groupBy("session_id", "kind").agg(F.min("number").alias("first"))
    return first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", "kind"))).alias("l")).select("session_id", F.array_join(F.transform("l", lambda x: x["kind"]), " -> ").alias("stages"))


@query("sess_qa_errors", f"SELECT session_id, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM {E} GROUP BY session_id")
def _(t):
    return fx.executions(t).groupBy("session_id").agg(F.count_if(F.col("status") == "failed").alias("errors"))


@query("sess_qa_search", f"SELECT session_id, number FROM (SELECT session_id, number, row_number() OVER (PARTITION BY session_id ORDER BY number) AS n FROM {I} WHERE contains(lower(input), 'the') OR kind = 'system') WHERE n <= 3")
def _(t):
    hit = fx.interactions(t).where(F.contains(F.lower("input"), F.lit("the")) | (F.col("kind") == "system"))
    return hit.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("number"))).where("n <= 3").select("session_id", "number")
