"""Running sums over keys of any size: ranges first, then offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioforge.session import fresh_path

#: Rows that a range is made for.
RANGE = 200_000


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """The rows with, for each name in `sums`, the running sum of its column over the rows of
    the same keys up to and with this one, in order; `order` must tell rows of a key apart.

    Rows are dealt to ranges of (keys, order), so a key with most rows has many. Each range
    sums its own rows of a key; the ranges' totals, one row for each key and range, are
    summed to offsets, and these added. No task has more than a range of one key, and only
    the totals of a key's ranges meet. Nulls are summed as zero; null keys are a key."""
    spark = rows.sparkSession
    n = ranges or max(1, -(-rows.count() // RANGE))
    path = fresh_path(spark, "ranges")
    # written, so that ranges are cut once: sampling anew would cut them elsewhere
    rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(StructType([*rows.schema, StructField("_range", IntegerType())])).parquet(path)
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    totals = cut.groupBy(*keys, "_range").agg(*(F.sum(value(c)).alias(f"_{name}") for name, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.select("*", *(F.sum(value(c)).over(inside).alias(name) for name, c in sums.items()))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = within.join(offsets, same)
    return out.select(*rows.columns, *((F.col(name) + F.col(f"_{name}")).alias(name) for name in sums))
