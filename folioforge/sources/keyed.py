"""Keyed tables on disk: bucketed and sorted by key, so that a merge moves only the changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import drop_path, fresh_path


class KeyedTable:
    """Rows of one key each, in `buckets` files by the key's hash, sorted by it. A version is
    never changed: a merge reads the buckets where they lie, deals the changes alike, and
    writes the next version bucket by bucket, which is then current; the one before is
    dropped once nothing reads it. The folder is in the cluster's shared one.

    Changes have one row a key; of several the greatest (in order of their columns) counts.
    Rows and changes without a key are left out."""

    def __init__(self, spark: SparkSession, key: str, buckets: int = 64):
        self.spark, self.key, self.buckets, self.version = spark, key, buckets, 0
        self.name, self.path = f"keyed_{uuid.uuid4().hex}", None

    def _table(self, version: int) -> str:
        return f"{self.name}_{version}"

    def _write(self, rows: DataFrame) -> None:
        path = fresh_path(self.spark, self.name)
        rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", path).saveAsTable(self._table(self.version + 1))
        before, self.path, self.version = (self._table(self.version), self.path), path, self.version + 1
        if self.version > 1:
            self.spark.sql(f"DROP TABLE {before[0]}")
            drop_path(self.spark, before[1])

    def create(self, rows: DataFrame) -> KeyedTable:
        """The first version; this one deal of all rows is the only one."""
        self._write(self._single(rows).repartition(self.buckets, self.key))
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self._table(self.version))

    def _single(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        last = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_r"))
        return last.select(self.key, *(F.col(f"_r.{c}").alias(c) for c in rest))

    def merged(self, changes: DataFrame) -> DataFrame:
        """The rows after the changes: known keys take the values that aren't null, unknown
        ones are added."""
        values = [c for c in changes.columns if c != self.key]
        new = self._single(changes).select(self.key, *(F.col(c).alias(f"_{c}") for c in values))
        rows = self.read()
        kept = [F.coalesce(f"_{c}", c).alias(c) if c in values else F.col(c) for c in rows.columns]
        return rows.join(new.hint("merge"), self.key, "full").select(*kept)

    def merge(self, changes: DataFrame) -> None:
        self._write(self.merged(changes))

    def remaining(self, gone: DataFrame) -> DataFrame:
        """The rows without the keys that are gone."""
        return self.read().join(gone.select(self.key).distinct().hint("merge"), self.key, "left_anti")

    def delete(self, gone: DataFrame) -> None:
        self._write(self.remaining(gone))

    def drop(self) -> None:
        if self.version:
            self.spark.sql(f"DROP TABLE {self._table(self.version)}")
            drop_path(self.spark, self.path)
            self.version, self.path = 0, None
