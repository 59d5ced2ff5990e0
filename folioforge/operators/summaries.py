"""Map and ordered fold of chunk summaries. Summaries come from a provider; the default
truncates, so results don't depend on a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import let

Provider = Callable[[Column], Column]


def truncating(n: int) -> Provider:
    return lambda c: F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


DEPTH = 12  # halvings of a chunk, at most


def pieces(chunk: Column, room: int) -> Column:
    """The chunk in order, halved until no piece has over `room` characters."""

    def cut(c: Column) -> Column:
        n = F.length(c)
        parts = F.pow(F.lit(2), F.least(F.lit(DEPTH), F.ceil(F.log2(F.greatest(n, F.lit(room)) / F.lit(float(room)))))).cast("int")
        return let(parts, lambda k: let(F.ceil(n / k).cast("int"), lambda size: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(c, i * size + 1, size))))

    return let(chunk, cut)


def mapped(chunks: DataFrame, provider: Provider = truncating(200), context: int = 8192, prompt: int = 0, reply: int = 300) -> DataFrame:
    """A summary of each chunk: doc_id, chunk_number, chunk -> doc_id, chunk_number, summary.

    Where prompt, chunk and reply (in tokens of four characters) would fill over 0.8 of the
    context, the chunk is halved until its pieces fit, and their summaries are joined in
    order. A piece for which the provider gives null, as one does that counts otherwise and
    finds the context exceeded, is tried again in quarters; what fails then is left out."""
    room = 4 * max(1, int(0.8 * context) - prompt - reply) + 3
    again = lambda c: F.array_join(F.transform(pieces_of(c, 4), provider), " ")
    each = lambda c: let(provider(c), lambda s: F.coalesce(s, again(c)))
    parts = let(pieces(F.col("chunk"), room), lambda p: F.when(F.size(p) == 1, p).otherwise(F.filter(p, lambda x: x != "")))
    return chunks.select("doc_id", "chunk_number", F.array_join(F.transform(parts, each), " ").alias("summary"))


def pieces_of(c: Column, n: int) -> Column:
    size = F.ceil(F.length(c) / n).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(c, i * size + 1, size)), lambda x: x != "")


def folded(summaries: DataFrame, budget: int) -> DataFrame:
    """Left-to-right rolling combination in chunk order, the last `budget` characters kept."""
    parts = summaries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_number", "summary"))).alias("p"))
    joined = lambda s, x: F.when(s == "", x["summary"]).otherwise(F.right(F.concat(s, F.lit(" "), x["summary"]), F.lit(budget)))
    return parts.select("doc_id", F.aggregate("p", F.lit(""), joined).alias("summary"))
