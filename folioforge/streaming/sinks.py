"""Sinks that a replayed micro-batch doesn't fill twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchSink:
    """A table of micro-batches. Each lies in a folder of its own, known by its id, and counts
    once its commit is written: a batch that broke off between its rows and its commit, or
    before the stream's own checkpoint, is written anew to the same folder, and one that is
    committed is passed over. Readers see committed batches only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def folder(self, batch: int) -> str:
        return f"{self.path}/rows/batch={batch}"

    def committed(self, batch: int) -> bool:
        fs, target = self._fs(f"{self.path}/commits/{batch}")
        return bool(fs.exists(target))

    def stage(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder(batch))

    def commit(self, batch: int) -> None:
        fs, target = self._fs(f"{self.path}/commits/{batch}")
        fs.create(target, True).close()

    def write(self, rows: DataFrame, batch: int) -> None:
        """A handler for foreachBatch. A committed batch is still computed, as operators with
        state have to see it again, but not kept."""
        if self.committed(batch):
            rows.write.format("noop").mode("overwrite").save()
        else:
            self.stage(rows, batch)
            self.commit(batch)

    def batches(self) -> list[int]:
        fs, target = self._fs(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(target)) if fs.exists(target) else []

    def read(self, schema) -> DataFrame:
        """Rows of all committed batches, with the batch that each came in."""
        there = [self.folder(b) for b in self.batches()]
        if not there:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*there)
        return rows.withColumn("batch", F.col("batch").cast("long"))


def split(sinks: dict[str, tuple[str, BatchSink]]) -> Callable[[DataFrame, int], None]:
    """A handler that sends the rows of each condition to its own sink, under one batch id."""

    def handle(rows: DataFrame, batch: int) -> None:
        for condition, sink in sinks.values():
            sink.write(rows.where(condition), batch)

    return handle
