"""Session state as a stream: actions and finished stages arrive in micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators import catalog
from folioforge.operators.sessions import STATE, Replay, plain, shown
from folioforge.streaming.sinks import BatchSink

ROWS = "session_id long, number long, stage string, allows boolean, action string, value string, target long"
OUT = STATE.format(key="long") + ", waiting long, idle boolean"
IDLE_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """A value state for each session: its replay, the number that comes next and the rows
    that came before their turn. A timer, set anew with each arrival, gives up on missing
    numbers: when a session has been idle, its waiting rows are applied in order. Rows of
    numbers already passed are repeats and change nothing, so a replayed batch is harmless."""

    def __init__(self, first: int = 0, idle_ms: int = IDLE_MS):
        self.first, self.idle_ms = first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "state string")

    def _load(self) -> tuple[Replay, int, dict]:
        if not self.state.exists():
            return Replay(), self.first, {}
        kept = json.loads(self.state.get()[0])
        return Replay(*kept["replay"]), kept["next"], {int(n): r for n, r in kept["waiting"].items()}

    def _kept(self, key, replay: Replay, due: int, waiting: dict, idle: bool) -> pd.DataFrame:
        self.state.update((json.dumps({"replay": replay.state(), "next": due, "waiting": waiting}),))
        names = [f.split()[0] for f in OUT.split(", ")]
        return pd.DataFrame([(key[0], *replay.state(), len(waiting), idle)], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        replay, due, waiting = self._load()
        for b in rows:
            for r in b.itertuples(index=False):
                if r.number >= due:
                    target = plain(r.target)
                    waiting.setdefault(int(r.number), (plain(r.stage), bool(plain(r.allows)), plain(r.action), plain(r.value), None if target is None else int(target)))
        while due in waiting:
            replay.step(due, *waiting.pop(due))
            due += 1
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._kept(key, replay, due, waiting, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        replay, due, waiting = self._load()
        for number in sorted(waiting):
            replay.step(number, *waiting[number])
            due = number + 1
        yield self._kept(key, replay, due, {}, True)


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state, which need another state store. Batches
    without data are off: timers would ask for one after another, so that a run over what is
    there never ends; timers fire with the next arrivals instead."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def arriving(spark: SparkSession, folder: str, per_trigger: int) -> DataFrame:
    """Rows (as in ROWS) from JSON files as they arrive; others than those are left out."""
    rows = stateful(spark).readStream.schema(ROWS).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.where("session_id IS NOT NULL AND number IS NOT NULL")


def run(rows: DataFrame, sink: BatchSink, checkpoint: str, processor: Sessions | None = None, handle=None):
    """Start the stream over all that has arrived; the sink gets each changed session's state.
    A restart with the same checkpoint goes on where the last commit was."""
    states = rows.groupBy("session_id").transformWithStateInPandas(processor or Sessions(), OUT, "Update", "ProcessingTime")
    return states.writeStream.outputMode("update").foreachBatch(handle or sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(sink: BatchSink) -> DataFrame:
    """The last state of each session, as `operators.sessions.replayed` gives it."""
    last = catalog.latest(sink.read(OUT).drop("idle", "waiting"), ["session_id"], "batch")
    return shown(last)
