"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits. For each bit a linear classifier over
hashed byte n-grams predicts it; decoding takes the codeword with the least logistic
loss, each bit weighted by how well its classifier does, and flags a text whose two
best codewords are close. Languages up to seven get the exhaustive code, more get a
random code with the best least distance of a fixed number of draws.

Fitting uses at most `per_language` labelled rows of each language, those of the
lowest hash of the id (a documented bound); prediction reads whole texts, all rows.

Defined results: a null text, or one without a letter, is `und` with score 0; of languages
with equal scores the first by name counts, and the text is ambiguous; a text of any
length is read whole; a null id is predicted but never learned from; repeated rows get
equal results; with no learned language all is `und`; columns other than doc_id, text,
lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import blocks, held_out, lean, tuned, utf8

BUCKETS = 4096
ROWS = 256  # rows of a block: bounds the dense counts to 8 MB
AMBIGUOUS = 0.2  # least difference of the two best scores

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte bigrams and trigrams."""
    rows = len(off) - 1
    out = np.zeros(rows * BUCKETS, np.float32)
    if len(buf) > 2:
        b = _KEEP[buf].astype(np.uint32)
        row = np.repeat(np.arange(rows), np.diff(off))
        for n, mult in ((2, np.uint32(0x9E3779B1)), (3, np.uint32(0x85EBCA6B))):
            x = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                x = (x << np.uint32(8)) | b[i : len(b) - n + 1 + i]
            h = (x * mult) >> np.uint32(32 - 12)
            inside = row[: len(x)] == row[n - 1 :]
            out += np.bincount(row[: len(x)][inside] * BUCKETS + h[inside], minlength=rows * BUCKETS).astype(np.float32)
    out = out.reshape(rows, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    out = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore")))
    return out


def code(k: int) -> np.ndarray:
    """k codewords of -1 and 1."""
    if k <= 7:
        bits = [(0, *x) for x in itertools.product((0, 1), repeat=k - 1) if any(x)]
        return 2 * np.array(bits or [(0,) * k]).T - 1
    length = math.ceil(10 * math.log2(k))
    draws = (2 * np.random.default_rng(seed).integers(0, 2, (k, length)) - 1 for seed in range(50))
    return max(draws, key=lambda m: (length - np.where(np.eye(k) > 0, -length, m @ m.T)).min())


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all bits at once, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    rate = 4 / 2.0  # rows have norm sqrt(2)
    for t in range(steps):
        z = np.clip(y * (x @ v), -30, 30)
        g = -(x.T @ (y / (1 + np.exp(z)))) / len(x) + ridge * v
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    right = ((x @ w) * y > 0).mean(0)
    return w, np.maximum(right - 0.5, 0.01).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], words: np.ndarray, w: np.ndarray, weight: np.ndarray):
        self.languages, self.words, self.w, self.weight = languages, words, w, weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = 4 * (x @ self.w[:-1] + self.w[-1])
        loss = np.stack([np.logaddexp(0, -m * f) @ self.weight for m in self.words], 1) / self.weight.sum()
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, per_language: int = 500) -> Model:
    """Learn from text and non-null lang of rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("k2", F.xxhash64("text"))
    known = rows.select("doc_id", "lang", "k2").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    # Some four times as many as are wanted go on to be ranked, however many there are.
    few = known.join(F.broadcast(known.groupBy("lang").count()), "lang").where(F.col("h") * F.col("count") < 4.0 * per_language * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "k2")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang", "k2")

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(0))
            for lo, hi in blocks(off, rows=ROWS):
                x = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    # per_language keys of each language; rows that repeat one are one row
    labelled = rows.join(F.broadcast(chosen), ["doc_id", "lang", "k2"], "left_semi").dropDuplicates(["doc_id", "lang", "k2"]).select("text", "lang").mapInArrow(lean(run), "lang string, x binary")
    got = sorted((r["lang"], bytes(r["x"])) for r in labelled.collect())
    if not got:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS + 1, 1), np.float32), np.ones(1, np.float32))
    languages = sorted({lang for lang, _ in got})
    words = code(len(languages))
    x = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    y = words[[languages.index(lang) for lang, _ in got]].astype(np.float32)
    w, weight = fit_bits(x, y)
    return Model(languages, words, w, weight)


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: str = "") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and ambiguous of each row; with
    `keep` (DDL), the columns of docs instead of doc_id and held_out come along."""
    sent = tuned(spark).sparkContext.broadcast(model)
    names = [f.split()[0] for f in keep.split(", ")] if keep else ["doc_id", "held_out"]
    sends = names if "text" in names else [*names, "text"]
    schema = f"{keep or 'doc_id long, held_out boolean'}, lang_pred string, score double, margin double, ambiguous boolean"

    def run(batches):
        m = sent.value
        labels = np.array([*m.languages, "und"], object)
        for b in batches:
            buf, off = utf8(b.column(sends.index("text")))
            for lo, hi in blocks(off, rows=ROWS):
                part, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                n, k = hi - lo, len(m.languages)
                best, score, margin = np.full(n, k), np.zeros(n), np.zeros(n)
                if k:
                    p = m.scores(features(part, at)).astype(float)
                    ranked, known = np.sort(p, 1), has_letter(part, at)
                    best = np.where(known, p.argmax(1), k)
                    score = np.where(known, ranked[:, -1], 0.0)
                    margin = np.where(known, ranked[:, -1] - (ranked[:, -2] if k > 1 else 0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, n) for c in b.columns[: len(names)]), pa.array(labels[best].tolist(), pa.string()), pa.array(score), pa.array(margin), pa.array(margin < AMBIGUOUS)],
                    names=[*names, "lang_pred", "score", "margin", "ambiguous"],
                )

    if not keep:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else c for c in sends)).mapInArrow(lean(run), schema)
