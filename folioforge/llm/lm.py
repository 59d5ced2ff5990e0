"""Stupid-backoff trigram scores from n-gram count tables over all documents.

Words are `[^\\x20\\x09-\\x0D]+`; a mark stands before the first word of a row. With f the
counts of n-grams in all rows and f' those without the row's own occurrences, a word c
after a, b scores f'(abc) / f'(ab) where f'(abc) > 0, else 0.4 times f'(bc) / f'(b) where
f'(bc) > 0, else 0.4 times 0.4 times f(c) / N; a row's first word starts at the second.

Rows are laid out in blocks of a few MB, each written once with its distinct words and the
place of each occurrence. A block asks the count tables, partitioned by ranges of the
n-gram's hash, for each of its distinct unigrams, bigrams and trigrams once, with its own
count; a partition sums what all blocks bring of an n-gram, joins the sums back to them
and the block sums the scores of each document. So an n-gram that stands everywhere is
one entry a block, and no partition holds more than its range. `PASSES` hash ranges go
one after another, each from the written blocks, so that only one lies on disk.

Defined results: a null or empty text has no words and score 0; rows are scored on their
own, those that repeat an id or have none included; ties can't occur; a text longer than
a block is a block of its own, whole; extra columns are ignored; an empty table gives no
rows. N-grams are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import blocks, discard, joint, lean, materialize, mix, pack_sorted, planes64, release, span_hash, trim, tuned, unpack_sorted, unplanes64, utf8, word_spans

BACKOFF = 0.4
START = np.uint64(0x5851F42D4C957F2D)
BLOCK = 4 << 20  # bytes of text
KEYS = 1 << 20  # distinct n-grams of all blocks that a count partition is made for
PASSES = 4
NO_ID = -(2**63) + 1


def blocked(docs: DataFrame) -> DataFrame:
    """The blocks: a key, ids and word counts of the rows, distinct word hashes (sorted)
    and the place among them of each word."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = np.asarray(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)
            buf, off = utf8(b.column(1))
            for lo, hi in blocks(off, BLOCK):
                part, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                s, e, row = word_spans(part, at)
                vocabulary, place = np.unique(span_hash(part, s, e), return_inverse=True)
                n = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_pydict({"block": [number], "n_words": [len(s)], "ids": [ids[lo:hi].tobytes()], "n": [planes64(n)], "vocabulary": [pack_sorted(vocabulary)], "place": [planes64(place)]}, pa.schema(fields))
                number += 1

    fields = [("block", pa.int64()), ("n_words", pa.int64()), *((c, pa.binary()) for c in ("ids", "n", "vocabulary", "place"))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "block long, n_words long, ids binary, n binary, vocabulary binary, place binary")


class Grams:
    """The n-grams of a block: keys of each order, and the row of each word."""

    def __init__(self, n: bytes, vocabulary: bytes, place: bytes):
        self.n = unplanes64(n).astype(np.int64)
        w = unpack_sorted(vocabulary)[unplanes64(place)]
        self.rows = len(self.n)
        self.row = np.repeat(np.arange(self.rows), self.n)
        full = np.flatnonzero(self.n)
        first = (np.cumsum(self.n) - self.n)[full]
        b = np.concatenate([w[:1], w[:-1]])
        b[first] = START
        two = joint(b, w)
        a = np.concatenate([w[:1], b[:-1]])  # the word before b; none before a row's mark
        three = joint(joint(a, b), mix(w))
        self.second = np.ones(len(w), bool)
        self.second[first] = False  # words that have a trigram
        self.first, self.full = first, full
        self.one, self.two, self.three = mix(w ^ np.uint64(1)), mix(two ^ np.uint64(2)), mix(three ^ np.uint64(3))
        self.mark = mix(np.array([START ^ np.uint64(1)]))[0]

    def keys(self, low: int, high: int) -> np.ndarray:
        """Keys of all orders, the row marks included, whose upper 32 bits lie in [low, high)."""
        out = np.concatenate([self.one, self.two, self.three[self.second], np.full(len(self.full), self.mark)])
        if (low, high) == (0, 1 << 32):
            return out
        top = out >> np.uint64(32)
        return out[(top >= low) & (top < high)]


def edges(buckets: int) -> np.ndarray:
    """First upper 32 bits of each hash range; the last is past all."""
    return np.array([-(-(k << 32) // buckets) for k in range(buckets + 1)], np.int64)


def asked(table: DataFrame, buckets: int, first: int, past: int) -> DataFrame:
    """Distinct n-grams of each block in the ranges first to past, with their counts."""
    edge = edges(buckets)

    def run(batches):
        for b in batches:
            for block, n, vocabulary, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, count = np.unique(Grams(n, vocabulary, place).keys(int(edge[first]), int(edge[past])), return_counts=True)
                cut = np.searchsorted(keys >> np.uint64(32), edge[first : past + 1].astype(np.uint64))
                full = np.flatnonzero(np.diff(cut))
                if len(full):
                    yield pa.RecordBatch.from_pydict({"bucket": full + first, "block": [block] * len(full), "keys": [pack_sorted(keys[cut[k] : cut[k + 1]]) for k in full], "counts": [planes64(count[cut[k] : cut[k + 1]]) for k in full]}, pa.schema(fields))

    fields = [("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
    return table.select("block", "n", "vocabulary", "place").mapInArrow(lean(run), "bucket long, block long, keys binary, counts binary")


def answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One count partition: its table summed over all blocks and joined to what each asked."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    cut = np.cumsum([0, *map(len, keys)])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    trim()
    table = np.zeros(at.max() + 1, np.int64)
    np.add.at(table, at, np.concatenate([unplanes64(c) for c in pdf["counts"]]).astype(np.int64))
    return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [planes64(table[at[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]})


def scored(block: pd.DataFrame, counts: pd.DataFrame, n_tokens: int) -> pd.DataFrame:
    """doc_id, n_words and the summed score of each row of one block."""
    ids, g = np.frombuffer(block["ids"].iloc[0], np.int64), Grams(*block[["n", "vocabulary", "place"]].iloc[0])
    trim()
    total = np.zeros(0, np.int64)
    if len(counts):
        total = np.concatenate([unplanes64(c) for c in counts.sort_values("bucket")["counts"]]).astype(np.int64)
    known, at = np.unique(g.keys(0, 1 << 32), return_inverse=True)
    n, m = len(g.one), int(g.second.sum())
    one, two, three, mark = at[:n], at[n : 2 * n], at[2 * n : 2 * n + m], at[2 * n + m :]
    rows = np.concatenate([g.row, g.row, g.row[g.second], g.full])
    _, own_at, own = np.unique(at * max(g.rows, 1) + rows, return_inverse=True, return_counts=True)
    left = total[at] - own[own_at]  # occurrences in other rows, of each occurrence's n-gram
    left1, left2, left3, left_mark = left[:n], left[n : 2 * n], left[2 * n : 2 * n + m], left[2 * n + m :]
    before = np.concatenate([left1[:1], left1[:-1]])
    before[g.first] = left_mark
    ratio = lambda x, y: np.log(np.maximum(x, 1) / np.maximum(y, 1))
    value = np.where(left2 > 0, ratio(left2, before), np.log(BACKOFF) + np.log(total[one] / n_tokens))
    second = np.flatnonzero(g.second)
    value[second] = np.where(left3 > 0, ratio(left3, left2[second - 1]), np.log(BACKOFF) + value[second])
    return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), ids == NO_ID), "n_words": g.n, "s": np.bincount(g.row, value, g.rows)})


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed) and per_word of each row."""
    tuned(spark)
    table = materialize(blocked(docs), "lm-blocks")
    n_tokens = table.agg(F.sum("n_words")).first()[0] or 0
    buckets = PASSES * max(16, -(-2 * n_tokens // (PASSES * KEYS)))
    answers = []
    for k in range(PASSES):
        some = asked(table, buckets, k * buckets // PASSES, (k + 1) * buckets // PASSES)
        answers.append(materialize(some.groupBy("bucket").applyInPandas(answered, "block long, bucket long, counts binary"), "lm-counts"))
        release(spark)
    counts = answers[0]
    for more in answers[1:]:
        counts = counts.unionByName(more)
    sums = table.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(lambda block, has: scored(block, has, max(n_tokens, 1)), "doc_id long, n_words long, s double")
    out = materialize(sums, "lm-scores")
    discard(table, *answers)
    return out.select("doc_id", "n_words", F.round("s", 4).alias("log_score"), F.round(F.col("s") / F.greatest("n_words", F.lit(1)), 6).alias("per_word"))
