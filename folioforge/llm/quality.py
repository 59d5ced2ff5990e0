"""Quality scores: random Fourier features of document statistics, ridge regression
from partition-summed normal equations, isotonic calibration.

The cosine features approximate a Gaussian kernel at two widths. Each partition sums
its outer products; Spark sums these place by place, and the driver solves one system of a
fixed size. Four fifths of the learning rows fit the ridge; the others
calibrate it, as counts and label sums of fixed score bins.

Defined results: a null or empty text has all-zero statistics and is scored like any
other; a text of any length is measured whole; a null id is scored but never learned from;
rows that repeat an id are rows of their own, each learned from if the id is labelled;
several labels of one id count as their largest; labels other than 0 and 1 are ignored;
ties can't occur; without labels of both kinds the score is 0.5; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import blocks, held_out, lean, materialize, mix, shingle_hash, span_hash, tuned, utf8, word_spans

WAVES = 384
PART = 20_000  # labelled rows whose equations a task sums
BINS = 1000
CUT = 0.7
PRIOR = 0.05  # weight of the mean label in a calibration bin

_CLASSES = np.zeros(256, np.int64)  # 0 other punctuation
for _k, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", "!?;:", "#$%&*@^~", "|<>{}[]\\/", "\"'()-_"), 1):
    _CLASSES[[ord(c) for c in _of]] = _k
_CLASSES[128:] = 11
_CLASSES[:9] = 12
N_CLASSES = 13


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of figures for each text."""
    rows, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(rows), size)
    share = np.bincount(row * N_CLASSES + _CLASSES[buf], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES) / np.maximum(size, 1)[:, None]
    nb = np.bincount(row * 32 + (buf >> 3), minlength=rows * 32).reshape(rows, 32) / np.maximum(size, 1)[:, None]
    entropy = -(nb * np.log(np.where(nb > 0, nb, 1))).sum(1)
    s, e, doc = word_spans(buf, off)
    n = np.bincount(doc, minlength=rows)
    per = np.maximum(n, 1)
    length = (e - s).astype(float)
    w = span_hash(buf, s, e)
    total = lambda v, d=doc: np.bincount(d, v, rows)
    mean = total(length) / per
    spread = np.sqrt(np.maximum(total(length**2) / per - mean**2, 0))
    first, last = buf[s] if len(s) else s, buf[e - 1] if len(s) else s
    again = np.zeros(len(s))
    again[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])

    def variety(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct share and the commonest one's share."""
        _, at, times = np.unique(keys ^ mix(of.astype(np.uint64)), return_index=True, return_counts=True)
        top = np.zeros(rows)
        np.maximum.at(top, of[at], times)
        m = np.maximum(np.bincount(of, minlength=rows), 1)
        return np.bincount(of[at], minlength=rows) / m, top / m

    kinds, top = variety(w, doc)
    three = shingle_hash(w, 3)
    inside = doc[: len(three)] == doc[2 : 2 + len(three)]
    kinds3, top3 = variety(three[inside], doc[: len(three)][inside])
    newline = np.zeros(256, bool)
    newline[10] = True
    ls, le, ldoc = word_spans(buf, off, newline)
    lines = np.bincount(ldoc, minlength=rows)
    line_kinds, _ = variety(span_hash(buf, ls, le), ldoc)
    odd = _CLASSES[last] >= 7 if len(s) else np.zeros(0)
    odd = odd & (_CLASSES[last] <= 9) if len(s) else odd
    columns = [np.log1p(size), np.log1p(n), np.log1p(lines), mean, spread, entropy, kinds, top, kinds3, top3, line_kinds, total(again) / per, total((length <= 3).astype(float)) / per, total((length >= 15).astype(float)) / per,
               total((_CLASSES[first] == 2).astype(float)) / per if len(s) else np.zeros(rows), total((_CLASSES[last] == 6).astype(float)) / per if len(s) else np.zeros(rows), total(odd.astype(float)) / per, np.log1p(n / np.maximum(lines, 1)), kinds * np.log1p(n)]
    out = np.column_stack([*columns, np.sqrt(share)]).astype(np.float32)
    out[size == 0] = 0
    return out


WIDTH = 19 + N_CLASSES


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the packed statistics of each row, whole texts."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            for lo, hi in blocks(off):
                x = statistics(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, x binary")


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, WIDTH).astype(float)


class Waves:
    """The feature map: standardised statistics to cosines of random directions."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        wide = np.repeat([0.35, 1.0], WAVES // 2)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.direction = rng.normal(size=(WIDTH, WAVES)) * wide / np.sqrt(WIDTH)
        self.shift = rng.uniform(0, 2 * np.pi, WAVES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.direction + self.shift) * np.sqrt(2 / WAVES), z / 10, np.ones((len(z), 1))])


def summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the vectors that `of` makes of Arrow batches: each partition sums
    its own, Spark the partitions' by place, so no task holds more than its share of them."""

    def partial(batches):
        total = None
        for b in batches:
            m = of(b.to_pandas())
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    got = rows.mapInArrow(lean(partial), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: neighbours that fall are pooled."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, n2 = stack.pop()
            v1, w1, n1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([x[0] for x in stack], [x[2] for x in stack])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    tuned(spark)
    rows = materialize(figures(docs), "quality-figures")
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()).join(marks, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("tunes"))
    known = materialize(known, "quality-known")
    known = known.coalesce(max(1, -(-known.count() // PART)))

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        x, y = unpack(pdf["x"]), pdf["y"].to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)])

    m = summed(known, moments)
    n, positive = (m[0], m[1]) if len(m) > 2 else (0, 0)
    if not n or positive in (0, n):
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    mean = m[2 : 2 + WIDTH] / n
    waves = Waves(mean, np.sqrt(np.maximum(m[2 + WIDTH :] / n - mean**2, 0)))

    size = WAVES + WIDTH + 2
    upper = np.triu_indices(size)

    def equations(pdf: pd.DataFrame) -> np.ndarray:
        z, y = waves(unpack(pdf["x"])), pdf["y"].to_numpy()
        z1 = np.hstack([z, y[:, None]])
        return (z1.T @ z1)[upper]

    a, found = np.zeros((size, size)), summed(known.where(~F.col("tunes")), equations)
    if len(found):
        a[upper] = found
        a = np.triu(a) + np.triu(a, 1).T
    beta = np.linalg.solve(a[:-1, :-1] + (ridge * max(a[-2, -2], 1)) * np.eye(size - 1) / 10, a[:-1, -1])

    def binned(pdf: pd.DataFrame) -> np.ndarray:
        raw = np.clip(waves(unpack(pdf["x"])) @ beta, -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, pdf["y"], BINS)])

    held = summed(known.where("tunes"), binned)
    count, ones = (held[:BINS], held[BINS:]) if len(held) > 1 else (np.zeros(BINS), np.zeros(BINS))
    full = np.flatnonzero(count)
    centre = (full + 0.5) / BINS * 2 - 0.5
    level = pool((ones[full] + PRIOR * positive / n) / (count[full] + PRIOR), count[full] + PRIOR) if len(full) > 1 else np.zeros(0)

    def run(batches):
        for b in batches:
            raw = np.clip(waves(unpack(b.column(2).to_pylist())) @ beta, -0.5, 1.5)
            p = np.interp(raw, centre, level) if len(level) else np.clip(raw, 0, 1)
            p = np.clip(p, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
