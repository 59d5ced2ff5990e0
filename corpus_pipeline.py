"""The corpus pipeline: five stages over `documents`, each written as Parquet and read
again as the next one's input. All but the last return the columns of documents.

Rows without an id or text pass through the stages by their operators' defined results: a
null or empty text has no language and goes in the first stage; of rows that repeat an id
and text one stays, and of ties for a representative the least (id, text hash); texts of
any length pass whole; an empty table gives an empty result; columns besides those of
documents are dropped. A stage's table is deleted once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontaminate, langid, paritysketch, suffixes
from folioforge.llm.common import discard, materialize, release, table
from folioforge.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
DDL = "doc_id long, text string, lang string, source string, n_chars long"

#: No SQL: language identification and tokenisation have none. Tested against brute force.
ORACLE_SQL = None


def known(docs: DataFrame) -> DataFrame:
    types = dict(f.split() for f in DDL.split(", "))
    return docs.select(*(F.col(c).cast(types[c]).alias(c) for c in COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones, told without ambiguity."""
    docs = known(docs)
    told = langid.predict(spark, docs, langid.fit(docs), keep=DDL)
    return told.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of similar ones."""
    return paritysketch.survivors(known(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters that repeated strings cover whole."""
    out = suffixes.dedup(known(docs), keep=COLUMNS, characters=True)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    out = decontaminate.scan(known(docs), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document."""
    return bpe.digests(spark, known(docs), vocabulary())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before:
            discard(before)
        before = docs
        release(spark)
    return docs
