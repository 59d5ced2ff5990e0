"""The file-arrival stream: one text file is one request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import analysis, safety
from folioforge.functions.text import preview, strip

MARK, LIMIT = "...[truncated]", 2000
SUMMARY_WORDS = ("summarize", "summary", "analyze file", "analyze document")


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Requests as they arrive: text files whose names don't start with a dot or tilde."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    name = analysis.file_name(F.col("_metadata.file_path"))
    ok = (analysis.extension(F.col("path")) == ".txt") & ~F.rlike("name", F.lit("^[.~]"))
    rows = raw.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), strip(F.col("value")).alias("request")).where(ok & (F.col("request") != ""))
    return rows.withColumn("request", preview(F.col("request"), LIMIT, MARK))


def packed(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Requests as they arrive in files of many: JSON lines of name and request, with the
    rules of single files."""
    raw = spark.readStream.schema("name string, request string").option("maxFilesPerTrigger", per_trigger).json(folder)
    ok = (analysis.extension(F.col("name")) == ".txt") & ~F.rlike("name", F.lit("^[.~]"))
    rows = raw.select(F.col("name").alias("path"), "name", strip(F.col("request")).alias("request")).where(ok & (F.col("request") != ""))
    return rows.withColumn("request", preview(F.col("request"), LIMIT, MARK))


def triaged(requests: DataFrame) -> DataFrame:
    """Requests with their category and handler, by keywords."""
    category = F.when(safety.any_of(F.lower("request"), SUMMARY_WORDS), "summarization").otherwise("sysadmin")
    rows = requests.withColumn("category", category)
    return rows.withColumn("handler", F.when(F.col("category") == "summarization", "summarize").otherwise("collaborate"))


def run(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the stream; `handle` gets each micro-batch. Offsets live in the checkpoint, so a
    restart loses no file, but a batch that broke off comes again: a handler has to know
    batches by their id, as `sinks.BatchSink` does."""
    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
