"""Exact top-k inner products by columnar branch-and-bound.

Vectors are quantised to floor(256 x). Candidates and queries are dealt into blocks of
bounded size; each pair of a query block and a candidate block is one task group. There
the candidates lie dimension by dimension; a query adds up one block of dimensions after
another and keeps only candidates whose partial score plus the product of the remaining
norms can still reach the k-th best exact score known, which the most promising of those
that are left raise after each block. Block results merge by rank. Each vector travels
once for a block of queries (so as often as there are blocks, which grow with the query
set), in two bytes a component where that is enough.

Defined results: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; rows that repeat an id are candidates of their own,
of other ids' queries only, and as queries share one ranking of k rows; a component that one of two vectors lacks counts as zero; equal
scores go to the smaller id; components beyond 62 bits count as the largest of 62 bits,
scores beyond 64 as the largest of 64; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import lean, materialize

CANDIDATES, QUERIES, DIMS = 8192, 4096, 8
BLOCK_BYTES = 32 << 20  # packed vectors that a block of candidates or queries is made for
WIDTHS = (np.int16, np.int32, np.int64)


def quantised(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and v: floor(256 x) of each component, packed."""
    good = F.forall(column, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = np.floor(256 * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float))
            flat = np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["vec_id", "v"])

    rows = vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & good)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e")).mapInArrow(lean(run), "vec_id long, v binary")


def packed(x: np.ndarray) -> bytes:
    """The narrowest width that holds all components, then these."""
    w = next(k for k, t in enumerate(WIDTHS) if not len(x) or np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
    return bytes([w]) + x.astype(WIDTHS[w]).tobytes()


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """The vectors cut or filled with zeros to one width, as numbers whose products are exact."""
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : min(len(x), width)] = x[:width]
    return out


def classes(rows: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Widths by powers of two, and which vectors are as wide: a few wide ones don't widen the rest."""
    width = np.array([len(x) for x in rows], np.int64)
    top = np.left_shift(1, np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64))
    return [(int(width[top == t].max()), np.flatnonzero(top == t)) for t in np.unique(top)]


class Columns:
    """Candidates in vertical layout with the norms that remain after each block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.columns = np.ascontiguousarray(vectors.T)
        self.cuts = list(range(0, vectors.shape[1], DIMS)) + [vectors.shape[1]]
        self.rest = self.remaining(vectors.astype(float))

    def remaining(self, v: np.ndarray) -> np.ndarray:
        v = np.atleast_2d(v)
        return np.stack([np.sqrt((v[:, c:] ** 2).sum(1)) for c in self.cuts])

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but `own`, best first."""
        rest = self.remaining(q.astype(float))[:, 0]
        alive = np.flatnonzero(self.ids != own)
        part = np.zeros(len(alive), self.columns.dtype)
        slack = 1e-9 * rest[0] * self.rest[0] + 0.5  # of the bounds' arithmetic
        floor = -np.inf
        for b, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            part = part + q[lo:hi] @ self.columns[lo:hi, alive]
            if hi == self.cuts[-1] or len(alive) <= k:
                continue
            bound = part.astype(float) + rest[b + 1] * self.rest[b + 1, alive]
            first = np.argpartition(bound, -k)[-k:]
            floor = max(floor, float(min(q @ self.columns[:, alive[first]])))
            kept = bound >= floor - slack[alive]
            alive, part = alive[kept], part[kept]
        order = np.lexsort((self.ids[alive], -part))[:k]
        return self.ids[alive[order]], part[order]


def search(spark: SparkSession, vectors: DataFrame, queries, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row for which `queries`, a
    condition on vec_id, holds, among all rows but its own."""
    rows = materialize(quantised(vectors, id_column, column), "vectors")
    asks = queries(F.col("vec_id"))
    n, asked, size, asked_size = rows.agg(F.count("*"), F.count(F.when(asks, 1)), F.sum(F.length("v")), F.sum(F.when(asks, F.length("v")))).first()
    ways = lambda m, most, size: max(1, -(-m // most), -(-(size or 0) // BLOCK_BYTES))
    cb, qb = ways(n, CANDIDATES, size), ways(asked, QUERIES, asked_size)
    deal = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select(each(qb).alias("qb"), deal(cb, 1).alias("cb"), F.lit(False).alias("asks"), "vec_id", "v")
    asking = rows.where(asks).select(deal(qb, 2).alias("qb"), each(cb).alias("cb"), F.lit(True).alias("asks"), "vec_id", "v")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asking, ids = pdf["asks"].to_numpy(), pdf["vec_id"].to_numpy()
        rows = [np.frombuffer(v, WIDTHS[v[0]], offset=1) for v in pdf["v"]]
        mine, theirs = np.flatnonzero(asking), np.flatnonzero(~asking)
        out = []
        for width, at in classes([rows[i] for i in theirs]):
            at = theirs[at]
            found, asked = matrix([rows[i] for i in at], width), matrix([rows[i] for i in mine], width)
            big = max(int(np.abs(found).max(initial=0)), int(np.abs(asked).max(initial=0)))
            kind = float if big * big * max(width, 1) < 2**52 else object  # exact either way
            found, asked = Columns(ids[at], found.astype(kind)), asked.astype(kind)
            for i, q in zip(mine, asked, strict=True):
                got, score = found.search(ids[i], q, k)
                out.append(pd.DataFrame({"query_id": np.full(len(got), ids[i]), "vec_id": got, "score": [max(-(2**63), min(2**63 - 1, int(s))) for s in score]}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    best = candidates.unionByName(asking).groupBy("qb", "cb").applyInPandas(block, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
