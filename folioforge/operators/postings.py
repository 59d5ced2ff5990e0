"""Text indexes: word postings with early stop for overlap ranking, and trigram bitmaps for
substring search."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import let
from folioforge.operators.vectors import ranked
from folioforge.session import fresh_path

#: Postings of a query's rarest words that the first bound is taken from.
FIRST = 4096


class Words(NamedTuple):
    texts: DataFrame  # id, words (distinct)
    postings: DataFrame  # word, id
    counts: DataFrame  # word, n


def words(text: Column) -> Column:
    """Distinct words by white space, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def written(rows: DataFrame, name: str) -> DataFrame:
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def indexed(texts: DataFrame) -> Words:
    """Word index of texts (id, text), in the shared folder. Postings lie in order of word and
    id, so a word that stands everywhere is spread over many files. A null text has no words."""
    rows = written(texts.select("id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words")), "texts")
    pairs = rows.select(F.explode("words").alias("word"), "id")
    postings = written(pairs.repartitionByRange("word", "id").sortWithinPartitions("word", "id"), "postings")
    return Words(rows, postings, written(postings.groupBy("word").agg(F.count("*").alias("n")), "word-counts"))


def best(index: Words, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, overlap (the share of the query's words that the text has, above 0) and
    rank of the best k texts of each query (query_id, text), ties to the smaller id.

    Max-score in two passes: the texts of a query's rarest words give k scores, the least of
    them a bound of b words. A text with b words of the query has one of its words but the
    b - 1 commonest, so only the postings of the others are read, and their texts are scored
    by their own words. Nothing is read for a word that everyone has, unless it is needed."""
    asked = queries.select("query_id", words(F.col("text")).alias("q")).where("q IS NOT NULL")
    terms = asked.select("query_id", F.size("q").alias("m"), F.explode("q").alias("word")).join(index.counts, "word")
    order = Window.partitionBy("query_id").orderBy("n", "word")
    terms = written(terms.withColumn("nth", F.row_number().over(order)).withColumn("so_far", F.sum("n").over(order)), "terms")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(index.texts, "id").join(asked, "query_id")
        return rows.select("query_id", "id", F.size(F.array_intersect("q", "words")).alias("shared"), F.size("q").alias("m"))

    early = terms.where((F.col("so_far") <= FIRST) | (F.col("nth") == 1)).join(index.postings, "word").groupBy("query_id", "id").agg(F.count("*").alias("c"))
    early = scored(ranked(early, ["query_id"], [F.desc("c"), F.col("id")], k, "nth").select("query_id", "id"))
    bound = early.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("shared")).otherwise(1).alias("bound"))
    known = terms.groupBy("query_id").agg(F.count("*").alias("known"))
    needed = terms.join(known.join(bound, "query_id", "left"), "query_id").where(F.col("nth") <= F.col("known") - F.coalesce("bound", F.lit(1)) + 1)
    pairs = needed.select("query_id", "word").join(index.postings, "word").select("query_id", "id").distinct()
    rows = scored(pairs).withColumn("overlap", F.col("shared") / F.col("m"))
    return ranked(rows, ["query_id"], [F.desc("overlap"), F.col("id")], k).select("query_id", "rank", "id", "overlap")


def grams(text: Column) -> Column:
    """Distinct runs of three characters, lower case."""
    runs = let(F.split(F.lower(text), ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    return F.array_distinct(F.when(F.length(text) > 2, runs))


def bitmaps(texts: DataFrame) -> DataFrame:
    """gram, word, bits: which of the 64 ids from 64 x word on have the gram. texts: id, text."""
    rows = texts.select(F.col("id").cast("long").alias("id"), F.explode(grams(F.col("text"))).alias("gram")).where("id IS NOT NULL")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    return rows.groupBy("gram", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def having(index: DataFrame, needle: str) -> DataFrame:
    """Ids of texts with all three-letter runs of a needle of three or more characters."""
    wanted = sorted({needle.lower()[i : i + 3] for i in range(len(needle) - 2)})
    if not wanted:
        raise ValueError("a shorter needle has no run of three characters: scan the texts")
    found = index.where(F.col("gram").isin(wanted)).groupBy("word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).where(F.col("n") == len(wanted))
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    rows = found.where("bits <> 0").select("word", "bits", bit).where(F.expr("shiftright(bits, bit) & 1 = 1"))
    return rows.select((F.col("word") * 64 + F.col("bit")).alias("id"))


def containing(texts: DataFrame, index: DataFrame, needle: str) -> DataFrame:
    """Texts (id, text) with the needle, whatever the case, and its first place (from 1): ids
    from the index, checked on the text."""
    at = F.instr(F.lower("text"), needle.lower())
    rows = texts if len(needle) < 3 else texts.join(having(index, needle), "id", "left_semi")
    return rows.withColumn("at", at).where("at > 0")
