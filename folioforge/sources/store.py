"""The document store: Parquet tables by database and collection, append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def add(self, rows: DataFrame) -> None:
        """Append rows that have db and collection columns."""
        rows.write.mode("append").partitionBy("db", "collection").parquet(self.path)

    def read(self, db: str | None = None, collection: str | None = None) -> DataFrame:
        """Rows of one or all databases and collections; folders of others aren't read."""
        out = self.spark.read.parquet(self.path)
        for c, v in (("db", db), ("collection", collection)):
            out = out.where(F.col(c) == v) if v else out
        return out

    def drop_collection(self, db: str, collection: str) -> bool:
        fs, target = self._fs(f"{self.path}/db={db}/collection={collection}")
        return bool(fs.delete(target, True))

    def reset(self, db: str = "all", confirm: bool = False) -> bool:
        """Drop a database's tables, or all; nothing without confirm."""
        if not confirm:
            return False
        fs, target = self._fs(self.path if db == "all" else f"{self.path}/db={db}")
        return bool(fs.delete(target, True))

    def stats(self) -> DataFrame:
        """Files and megabytes of each database."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path)
        db = F.regexp_extract("path", "/db=([^/]+)/", 1)
        return files.groupBy(db.alias("db")).agg(F.count("*").alias("files"), F.round(F.sum("length") / 1e6, 3).alias("mb"))

    def health(self) -> DataFrame:
        """Named checks and whether they hold, with totals."""
        rows = self.read()
        one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("no_id"), F.countDistinct("db").alias("dbs"), F.count_if(F.size("embedding") < 1).alias("empty"), F.countDistinct(F.size("embedding")).alias("dims"))
        checks = F.explode(F.create_map(F.lit("has rows"), F.col("n") > 0, F.lit("ids"), F.col("no_id") == 0, F.lit("databases"), F.col("dbs") > 0, F.lit("vectors"), F.col("empty") == 0, F.lit("one dimension"), F.col("dims") == 1)).alias("check", "passed")
        return one.select(checks)


def updated(rows: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows merged with changes (the key and new values): a known key takes the values that
    aren't null and counts one more access, an unknown one is added; the last of a key's
    changes isn't defined, so give one each."""
    values = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(1).alias("_touched"))
    out = rows.join(new, key, "full")
    for c in values:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_touched", F.lit(0))).select(*rows.columns)
