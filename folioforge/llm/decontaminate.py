"""Benchmark decontamination over a distributed positional inverted index.

The postings (term, document, position) of every training token whose term occurs in the
test items are written as index segments: one for each part of the documents, ordered by
term, so nothing is shuffled to build them and a look-up of few terms reads few pages. The
lists of each window's rarest terms by corpus count are taken out of the index, once. For
exact matches the rarest term's list, shifted by its offset, is intersected with the next
rarest one's, shifted likewise; only the postings of documents that are left are read
again, to intersect the lists of all words of the item at that shift. Runs of matched
words as long as a window are exact phrase matches.

A window matches in proximity where one of its `missing` + 1 rarest words (ties by place)
stands and all but `missing` of its words, that one included, stand each within `slack`
words of their place from there. So of the `missing` + 2 rarest two must stand near their
places: lists of these meet by item and rounded shift, and only documents where two do
are verified. So by default all words of a window must be there, in any order and with
others between them; `missing` words may be others, at the price of longer lists (each
more takes in the postings of the next rarest word of all windows). It counts once for
five words of the window at most; an exact match is one in proximity too.

All steps are DataFrame operations. Relations of the test items are broadcast only while
their counted rows stay below `BROADCAST_ROWS`; beyond it the same joins shuffle. The
documents to read again are marked in a bitmap of fixed size.

Defined results: A-Z are lower-cased and words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`;
a null text has no words; an item without words matches nothing, one shorter than a window
is one window; items without an id are ignored and ids that repeat count once; rows that
repeat an id are rows of their own; a text of any length is indexed whole; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import discard, keyed, marked, materialize

WORDS = 10
SLACK, MISSING = 3, 0
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Items:
    """Test items as relations: words by position, terms, and windows."""

    def __init__(self, items: DataFrame, window: int = WORDS, missing: int = MISSING):
        rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).distinct()
        rows = rows.where(F.size("w") > 0).withColumn("item", F.xxhash64("item_id", "w"))
        need = F.least(F.size("w"), F.lit(window))
        self.rows = materialize(rows.select("item", "item_id", F.size("w").alias("size"), need.alias("need"), F.least(F.lit(missing), F.floor(need / 5)).cast("int").alias("spare"), "w"), "items")
        placed = self.rows.select("item", "need", "spare", "size", F.posexplode("w").alias("ip", "word"))
        self.terms = materialize(placed.select("word").distinct().withColumn("term", F.xxhash64("word")), "item-terms")
        self.placed = small(placed.select("item", "need", "spare", "size", "ip", F.xxhash64("word").alias("term")))


def index(docs: DataFrame, items: Items) -> DataFrame:
    """The stored segments: term, k1, k2, pos of each token that is a term of the items."""
    tokens = docs.select("k1", "k2", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return materialize(tokens.join(small(items.terms), "word").select("term", "k1", "k2", "pos").sortWithinPartitions("term"), "postings")


class Search:
    """The rarest words of each window and their postings."""

    def __init__(self, postings: DataFrame, items: Items):
        self.postings, self.items = postings, items
        counts = postings.groupBy("term").agg(F.count("*").alias("cf"))
        known = items.placed.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
        windows = known.withColumn("ws", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ip") - F.col("need") + 1), F.least(F.col("ip"), F.col("size") - F.col("need")))))
        lists = F.slice(F.sort_array(F.collect_list(F.struct("cf", "ip", "term"))), 1, F.first("spare") + 2)
        self.windows = materialize(windows.groupBy("item", "ws").agg(F.first("need").alias("need"), F.first("spare").alias("spare"), lists.alias("lists")), "windows")
        self.rare = small(materialize(self.windows.select("item", F.explode("lists").alias("x")).select("item", "x.ip", "x.term").distinct(), "rare-words"))
        self.lists = materialize(postings.join(small(self.rare.select("term").distinct()), "term"), "rare-postings")

    def drop(self) -> None:
        discard(self.windows, self.lists)


def candidates(search: Search) -> DataFrame:
    """k1, k2, item and shift (document position of the item's first word) where the two
    rarest words of a window stand."""
    first, second = F.col("lists")[0], F.element_at("lists", F.least(F.size("lists"), F.lit(2)))
    pivots = search.windows.where(first["cf"] > 0).select("item", first["ip"].alias("ip"), first["term"].alias("term"), second["ip"].alias("ip2"), second["term"].alias("term2")).distinct()
    rarest = search.lists.join(small(pivots), "term").select("k1", "k2", "item", (F.col("pos") - F.col("ip")).alias("shift"), "ip2", "term2")
    next_ = rarest.groupBy("k1", "k2", (F.col("shift") + F.col("ip2")).alias("pos"), F.col("term2").alias("term")).agg(F.collect_set(F.struct("item", "shift")).alias("at"))
    both = next_.join(search.lists, ["k1", "k2", "pos", "term"], "left_semi").select("k1", "k2", F.explode("at").alias("at")).select("k1", "k2", "at.*")
    return materialize(both.distinct(), "candidates")


def phrases(search: Search) -> DataFrame:
    """k1, k2, item, start and end (past) of each maximal run of matched item words that
    holds a window; document positions."""
    found = candidates(search)
    wanted = found.join(search.items.placed, "item").select("k1", "k2", (F.col("shift") + F.col("ip")).alias("pos"), "term", "item", "shift", "need")
    matched = wanted.join(marked(search.postings, found), ["k1", "k2", "pos", "term"]).distinct()
    order = Window.partitionBy("k1", "k2", "item", "shift").orderBy("pos")
    islands = matched.withColumn("island", F.col("pos") - F.row_number().over(order))
    runs = islands.groupBy("k1", "k2", "item", "shift", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.min("need").alias("need"))
    out = materialize(runs.where("end - start >= need").select("k1", "k2", "item", "start", "end"), "phrases")
    discard(found)
    return out


def proximity(search: Search, exact: DataFrame, slack: int = SLACK) -> DataFrame:
    """k1, k2, item where a window matches in proximity; `exact` (k1, k2, item) do so anyway."""
    exact, wide = exact.select("k1", "k2", "item").distinct(), 4 * slack + 4
    shift = F.col("pos") - F.col("ip")
    cells = search.lists.join(search.rare, "term").select("k1", "k2", "item", "ip", F.floor(shift / wide).alias("cell"))
    cells = cells.select("k1", "k2", "item", "ip", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    two = cells.groupBy("k1", "k2", "item", "cell").agg(F.min("ip").alias("a"), F.max("ip").alias("b")).where("a < b")  # shifts a slack apart share a cell
    two = materialize(two.select("k1", "k2", "item", "cell").join(exact, ["k1", "k2", "item"], "left_anti"), "near-cells")
    wanted = two.join(search.items.placed, "item").select("k1", "k2", "term", "item", "cell", "ip")
    inside = (shift >= (F.col("cell") - 1) * wide - slack) & (shift < (F.col("cell") + 1) * wide + slack)
    there = wanted.join(marked(search.postings, two), ["k1", "k2", "term"]).where(inside)
    there = materialize(there.select("k1", "k2", "item", "cell", "ip", shift.alias("shift")).distinct(), "near-words")
    pivots = search.windows.select("item", "ws", "need", "spare", F.posexplode("lists").alias("nth", "x")).where("nth <= spare").select("item", "ws", "need", "spare", F.col("x.ip").alias("ip"))
    at = there.join(small(pivots), ["item", "ip"]).select("k1", "k2", "item", "cell", "ws", "need", "spare", F.col("shift").alias("at")).distinct()
    met = at.join(there, ["k1", "k2", "item", "cell"]).where((F.col("ip") >= F.col("ws")) & (F.col("ip") < F.col("ws") + F.col("need")) & (F.abs(F.col("shift") - F.col("at")) <= slack))
    full = met.groupBy("k1", "k2", "item", "cell", "ws", "at").agg(F.countDistinct("ip").alias("met"), F.min(F.col("need") - F.col("spare")).alias("least")).where("met >= least")
    out = materialize(exact.unionByName(full.select("k1", "k2", "item").distinct()), "near-items")
    discard(two, there)
    return out


def scan(docs: DataFrame, items: DataFrame, window: int = WORDS, keep: tuple[str, ...] = ("doc_id",), slack: int = SLACK, missing: int = MISSING) -> DataFrame:
    """The `keep` columns, n_words, n_hit, n_items, item_ids (sorted), contaminated, n_near
    and near_ids (items with a match in proximity) of each row."""
    rows = keyed(docs)
    tested = Items(items, window, missing)
    postings = index(rows, tested)
    search = Search(postings, tested)
    hits = phrases(search)
    near = proximity(search, hits, slack)
    search.drop()
    discard(postings)
    before = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("k1", "k2", "start", "end").distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))
    named = small(tested.rows.select("item", "item_id"))
    ids = lambda found, name: found.join(named, "item").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias(name))
    marks = ids(near, "near_ids").join(n_hit, ["k1", "k2"], "left").join(ids(hits, "item_ids"), ["k1", "k2"], "left")
    text = F.col("text").cast("string")
    every = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("k1"), F.xxhash64(text).alias("k2"), F.size(words(text)).cast("long").alias("n_words"))
    out = every.join(marks, ["k1", "k2"], "left")
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    count = lambda c: F.size(F.coalesce(c, none)).cast("long")
    return out.select(*keep, "n_words", hit.alias("n_hit"), count("item_ids").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), (hit > 0).alias("contaminated"), count("near_ids").alias("n_near"), F.coalesce("near_ids", none).alias("near_ids"))
