"""Sessions, checkpoints and their history over append-only tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import drop_path, fresh_path


def checkpoints(history: DataFrame) -> DataFrame:
    """One checkpoint after each interaction: numbered, with its parent and whether a
    snapshot allows a rollback. history: session_id, number, kind, input."""
    order = Window.partitionBy("session_id").orderBy("number")
    key = F.concat_ws(":", F.col("session_id").cast("string"), F.col("number").cast("string"))
    rows = history.withColumn("checkpoint_number", F.row_number().over(order)).withColumn("checkpoint_id", F.substring(F.md5(key), 1, 12))
    return rows.withColumn("parent_id", F.lag("checkpoint_id").over(order)).withColumn("can_rollback", F.col("kind") != "system")


def rolled_back(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Checkpoints that stay after each session goes back to its target number, if the
    target exists and allows it. targets: session_id, target."""
    allowed = points.join(targets, "session_id").where((F.col("checkpoint_number") == F.col("target")) & F.col("can_rollback")).select("session_id", "target")
    return points.join(allowed, "session_id").where(F.col("checkpoint_number") <= F.col("target"))


CRITICAL = ("triage", "execution_complete", "completion_review", "error")
MAJOR = ("triage", "security", "execution", "completion_review", "knowledge_query")


def wants_checkpoint(frequency: Column, stage: Column) -> Column:
    return (
        F.when(frequency == "none", stage == "final_completion")
        .when(frequency == "minimal", stage.isin(*CRITICAL))
        .when(frequency == "detailed", F.lit(True))
        .otherwise(stage.isin(*MAJOR))
    )


#: Numbers of a session that are replayed in one round.
SEGMENT = 100_000
STATE = "session_id {key}, applied long, ended boolean, request string, rollbacks long, refused long, numbers array<long>, stages array<string>, open array<boolean>"


class Replay:
    """A session while its rows are replayed in order. Each row is a finished stage, whose
    checkpoint goes on a stack with a snapshot of the session, and then the user's action:
    STOP ends the session, MODIFY replaces its request (by one that isn't empty), ROLLBACK
    restores the snapshot of a checkpoint that is on the stack and allows it, and drops the
    later ones; others change nothing. The results and history of a snapshot are the stages
    below it, so the stack holds them once; a request outlives a rollback."""

    def __init__(self, applied=0, ended=False, request=None, rollbacks=0, refused=0, numbers=(), stages=(), open=()):  # noqa: A002
        self.applied, self.ended, self.request, self.rollbacks, self.refused = int(applied), bool(ended), request, int(rollbacks), int(refused)
        self.numbers, self.stages, self.open = [int(n) for n in numbers], list(stages), [bool(o) for o in open]

    def step(self, number: int, stage: str | None, allows: bool, action: str | None, value: str | None, target: int | None) -> None:
        self.applied += 1
        if self.ended:
            return
        self.numbers.append(int(number))
        self.stages.append(stage)
        self.open.append(bool(allows))
        if action == "STOP":
            self.ended = True
        elif action == "MODIFY" and value:
            self.request = value
        elif action == "ROLLBACK" and target is not None:
            to = int(target)
            if 1 <= to <= len(self.numbers) and self.open[to - 1]:
                self.rollbacks += 1
                del self.numbers[to:], self.stages[to:], self.open[to:]
            else:
                self.refused += 1

    def state(self) -> tuple:
        return self.applied, self.ended, self.request, self.rollbacks, self.refused, self.numbers, self.stages, self.open


def plain(v):
    """A cell of a pandas row, its kinds of null as None."""
    return None if v is None or v != v else v


def shown(states: DataFrame) -> DataFrame:
    """Session rows: the fields that the last snapshot or stage left, and the checkpoints kept."""
    top = F.size("numbers")
    return states.select(
        "session_id", "ended", "request", "rollbacks", "refused", top.cast("long").alias("checkpoints"),
        F.when(top > 0, F.element_at("stages", -1)).alias("stage"), F.when(top > 0, F.element_at("numbers", -1)).alias("cycle"), F.array_join("numbers", ",").alias("history"),
    )


def replayed(actions: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Sessions after their rows (session_id, number, stage, allows, action, value, target).

    The fold is ordered and can't be split, so long sessions go in rounds: each takes one
    segment of numbers of every session, streams it sorted through tasks and writes the
    states, which are the next round's first rows. A task holds one session's stack.
    Rows without a session or number are left out; of rows that repeat both, the first in
    order of their other columns counts."""
    spark, columns = actions.sparkSession, ["stage", "allows", "action", "value", "target"]
    rows = actions.where("session_id IS NOT NULL AND number IS NOT NULL").select("session_id", F.col("number").cast("long").alias("number"), *columns)
    rows = rows.withColumn("segment", F.floor(F.col("number") / segment).cast("long"))
    schema = STATE.format(key=rows.schema["session_id"].dataType.simpleString())
    kept = [f.split()[0] for f in schema.split(", ")][1:]

    def run(batches):
        now, replay, last, out = None, None, None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if replay is None or r.session_id != now:
                    if replay is not None:
                        out.append((now, *replay.state()))
                    now, replay, last = r.session_id, Replay(), None
                if r.number_ is None or r.number_ != r.number_:
                    last = None
                    replay = Replay(*(plain(getattr(r, c)) if c not in ("numbers", "stages", "open") else getattr(r, c) for c in kept))
                elif r.number_ != last:
                    last = r.number_
                    replay.step(r.number_, plain(r.stage), bool(plain(r.allows)), plain(r.action), plain(r.value), plain(r.target))
            yield pd.DataFrame(out, columns=["session_id", *kept])
            out = []
        yield pd.DataFrame([(now, *replay.state())] if replay is not None else [], columns=["session_id", *kept])

    states, path, order = None, None, ["session_id", F.col("number_").asc_nulls_first(), *columns]
    for (n,) in sorted(rows.select("segment").distinct().collect()):
        some = rows.where(F.col("segment") == n).drop("segment").withColumnRenamed("number", "number_")
        if states is not None:
            some = some.unionByName(states, allowMissingColumns=True)
        else:
            some = some.select("*", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")[1:]))
        step = some.repartition("session_id").sortWithinPartitions(*order).mapInPandas(run, schema)
        before, path = path, fresh_path(spark, "sessions")
        step.write.parquet(path)
        states = spark.read.schema(schema).parquet(path)
        if before:
            drop_path(spark, before)
    return shown(states if states is not None else spark.createDataFrame([], schema))


def depths(points: DataFrame) -> DataFrame:
    """How many checkpoints lie before each one on its chain of parents, by pointer jumping:
    each round doubles the way up, so a chain of any length takes its logarithm in rounds.
    points: session_id, checkpoint_id, parent_id; a parent that isn't there ends a chain."""
    spark = points.sparkSession
    own = points.select("session_id", "checkpoint_id", F.col("parent_id").alias("up"))
    known = own.select("session_id", F.col("checkpoint_id").alias("up"), F.lit(1).alias("there"))
    now = own.join(known, ["session_id", "up"], "left").select("session_id", "checkpoint_id", F.when(F.col("there") == 1, F.col("up")).alias("up"), F.coalesce("there", F.lit(0)).cast("long").alias("depth"))
    path = None
    while True:
        before, path = path, fresh_path(spark, "chains")
        now.write.parquet(path)
        if before:
            drop_path(spark, before)
        now = spark.read.schema(now.schema).parquet(path)
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("session_id", "checkpoint_id", "depth")
        above = now.select("session_id", F.col("checkpoint_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = now.join(above, ["session_id", "up"], "left").select("session_id", "checkpoint_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
