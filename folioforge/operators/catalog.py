"""Catalog and cache operators over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(catalog: DataFrame, new: DataFrame, extra: Column) -> DataFrame:
    """The new documents whose path the catalog doesn't have, with extra fields as JSON."""
    return new.join(catalog.select("file_path"), "file_path", "left_anti").withColumn("metadata_json", F.to_json(extra))


def updated(catalog: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The catalog with the given columns replaced where changes has the document."""
    renamed = changes.select("doc_id", F.lit(True).alias("_touched"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = catalog.join(renamed, "doc_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out.withColumn("touched", F.coalesce("_touched", F.lit(False))).drop("_touched")


def found(catalog: DataFrame, **equal) -> DataFrame:
    """Documents that equal all given values; none given finds none."""
    out = catalog if equal else catalog.limit(0)
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def listed(catalog: DataFrame, doc_type: str | None = None, author: str | None = None, limit: int = 100) -> DataFrame:
    out = catalog.where(F.col("doc_type") == doc_type) if doc_type else catalog
    out = out.where(F.col("author").ilike(f"%{author}%")) if author else out
    return out.orderBy(F.desc("total_tokens"), "doc_id").limit(limit)


def surrounding(targets: DataFrame, chunks: DataFrame, reach: int) -> DataFrame:
    """Chunks of the same document at most `reach` numbers away; an equi-join on exploded
    numbers, so no range join is needed."""
    near = targets.select(F.col("chunk_id").alias("target"), "doc_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_number") - reach), F.col("chunk_number") + reach)).alias("chunk_number"))
    return near.join(chunks, ["doc_id", "chunk_number"])


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log; sums map-side before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def changes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """new, gone, hit or stale for each path of files or cache."""
    a = files.select("file_path", F.col("file_hash").alias("now"))
    b = cache.select("file_path", F.col("file_hash").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("then"), "hit").otherwise("stale")
    return a.join(b, "file_path", "full").select("file_path", state.alias("state"))
