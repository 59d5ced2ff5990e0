"""Product codes of vectors: Lloyd's rounds with Hamerly's bounds, in whole numbers.

Components become floor(1024 x), and vectors are cut into equal consecutive parts, each
with a codebook of its own, which starts as that part of the vectors of least id. A round
assigns every part to its nearest entry and replaces each entry by the floored mean of its
parts. The vectors lie in a table beside their assignments, an upper bound of the distance
to the own entry and a lower bound of that to any other, one of each for every part. When
entries move, the bounds move by as much; a part keeps its entry where its upper bound lies
strictly below its lower one, or below half the way from its entry to the next one. Else
the own distance is taken exactly, and only where that doesn't settle it either are all
entries scanned, in whole numbers, so that of equally near ones the lower index wins.
Bounds are compared with a margin for rounding, so they never decide a tie.

Each pass reads the table and writes the next one in the shared folder; the one before is
deleted. The driver sees the codebooks, their sums and counts only: entries x width
numbers, whatever the number of vectors.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; a row without an id is coded as well and comes after those with one; rows that
repeat an id are rows of their own, in order of their components; shorter vectors and
widths that the number of parts doesn't divide are filled up with zeros, to the widest
vector; fewer vectors than entries make fewer entries; equal entries are told by index;
components beyond 62 bits count as the largest of 62 bits, errors beyond 64 as the largest
of 64; null labels are one label; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import discard, lean, materialize, tuned

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 4096  # vectors that are compared with a codebook at once
LABELS = 100_000  # sums of labels that are sent to every task; more are joined by shuffle
STATE = "id long, label {label}, v binary, code binary, upper binary, lower binary, error long, scans int"


class Book(NamedTuple):
    """The codebooks before and after a round: parts x entries x width of a part."""

    old: np.ndarray | None
    new: np.ndarray


def kind_of(largest: int, width: int) -> type:
    """Numbers in which squared distances over `width` components are exact."""
    return np.float64 if 4 * largest * largest * max(width, 1) < 2**52 else object


def finite(column: str):
    return F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * np.asarray(flat, float)), -(2.0**62), 2.0**62).astype(np.int64)


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(x, float))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, exact."""
    return squares(x)[:, None] - 2 * (x @ book.T) + squares(book)[None]


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (of ties the lower index), its squared distance and that of the second."""
    best, least, second = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), np.full(len(x), np.inf)
    for lo in range(0, len(x), ROWS):
        d = distances(x[lo : lo + ROWS], book)
        at = d.argmin(1)
        best[lo : lo + ROWS], least[lo : lo + ROWS] = at, d[np.arange(len(d)), at]
        if d.shape[1] > 1:
            d[np.arange(len(d)), at] = d.max(1)
            second[lo : lo + ROWS] = d.min(1)
    return best, least, second


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each entry moves, how far any other one at most, and half the way to the next."""
    way = roots(squares(new - old))
    other = np.full(len(way), way.max())
    if len(way) > 1:
        top = int(way.argmax())
        other[top] = np.delete(way, top).max()
    between = distances(new, new)
    apart = np.full(len(new), np.inf)
    for j in range(len(new)):
        rest = np.delete(between[j], j)
        if len(rest):
            apart[j] = roots(rest.min()) / 2
    return way, other, apart


def assigned(x: np.ndarray, book: Book, k: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Assignment, bounds and a flag for each full scan of part k of the vectors."""
    new = book.new[k]
    if book.old is None:
        code, least, second = scanned(x, new)
        return code, roots(least), roots(second), np.ones(len(x), bool)
    way, other, apart = moved(book.old[k], new)
    code, upper, lower = code.copy(), upper + way[code], lower - other[code]

    def settled(u, w, at):
        floor = np.maximum(w, apart[at])
        return u + 1e-9 + 1e-12 * (u + way.max()) < floor * (1 - 1e-12)

    open_ = np.flatnonzero(~settled(upper, lower, code))
    upper[open_] = roots(squares(x[open_] - new[code[open_]]))
    open_ = open_[~settled(upper[open_], lower[open_], code[open_])]
    code[open_], least, second = scanned(x[open_], new)
    upper[open_], lower[open_] = roots(least), roots(second)
    scans = np.zeros(len(x), bool)
    scans[open_] = True
    return code, upper, lower, scans


def vectors_of(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), width).astype(kind)


def passed(state: DataFrame, book: Book, last: bool) -> DataFrame:
    """The table after one assignment; the last one has the exact errors."""
    parts, _, width = book.new.shape
    sent = state.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        book = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column("v"), parts * width, book.new.dtype).reshape(-1, parts, width)
            read = lambda c, kind, b=b: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, parts)
            was = (np.zeros((len(x), parts), np.int64), *[np.zeros((len(x), parts))] * 2) if book.old is None else (read("code", np.uint16).astype(np.int64), read("upper", float), read("lower", float))
            columns = [assigned(x[:, k], book, k, *(c[:, k] for c in was)) for k in range(parts)]
            code, upper, lower, scans = (np.stack(c, 1) for c in zip(*columns, strict=True))
            error = np.zeros(len(x), object if last else np.int64)
            if last:
                error = sum((squares(x[:, k] - book.new[k][code[:, k]]).astype(object) for k in range(parts)), error)
                error = np.array([min(2**63 - 1, int(e)) for e in error], np.int64)
            packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            out = {"id": b.column("id"), "label": b.column("label"), "v": b.column("v"), "code": packed(code.astype(np.uint16)), "upper": packed(upper), "lower": packed(lower), "error": pa.array(error), "scans": pa.array(scans.sum(1).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return state.mapInArrow(lean(run), STATE.format(label=state.schema["label"].dataType.simpleString()))


def replaced(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after the round: floored means; entries without parts stay."""
    parts, entries, width = books.shape
    kind = books.dtype

    def run(batches):
        total, count = np.zeros((parts, entries, width), object if kind == object else np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column("v"), parts * width, total.dtype).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint16).reshape(-1, parts)
            for k in range(parts):
                np.add.at(total[k], code[:, k], x[:, k])
                count[k] += np.bincount(code[:, k], minlength=entries)
        k, e = np.nonzero(count)
        slot, n = (k * entries + e).astype(np.int64), count[k, e]
        # whole numbers of any size as a high and a low part of 32 bits
        high, low = (total[k, e] >> 32).astype(np.int64), (total[k, e] & 0xFFFFFFFF).astype(np.int64)
        lists = [pa.array(list(c), pa.list_(pa.int64())) for c in (high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n), *lists], names=["slot", "n", "high", "low"])

    sums = state.select("v", "code").mapInArrow(lean(run), "slot long, n long, high array<long>, low array<long>")
    sums = sums.select("slot", "n", F.posexplode_outer(F.arrays_zip("high", "low")).alias("pos", "x")).groupBy("slot", "pos").agg(F.sum("n").alias("n"), F.sum("x.high").alias("high"), F.sum("x.low").alias("low"))
    out = books.copy()
    for slot, pos, n, high, low in sums.collect():  # at most parts x entries x width rows
        if pos is not None:
            out[slot // entries, slot % entries, pos] = ((high << 32) + low) // n
    return out


def compressed(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding", label: str = "label", kept: list | None = None) -> DataFrame:
    """vec_id, code (hex of the entries' indexes), error, label_error and codebooks_sha256.
    `kept` gets the codebooks (parts x entries x width) and, of each pass, the full scans."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is written in two hex digits")
    tuned(spark)
    rows = vectors.where(finite(column)).select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("e"))
    widest, low, high = rows.agg(F.max(F.size("e")), F.min(F.array_min("e")), F.max(F.array_max("e"))).first()
    width = -(-(widest or 0) // parts)
    largest = max(abs(int(c)) for c in whole(np.array([low or 0, high or 0]), scale))
    kind = kind_of(largest, width)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "e").limit(entries).select("e").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.e)] = whole(r.e, scale)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)).astype(kind)

    def packed(batches):
        for b in batches:
            flat, size = whole(b.column(2).flatten().to_numpy(zero_copy_only=False), scale), b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.cumsum(size) - size
            x = np.zeros((len(size), parts * width), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            x[row, np.arange(len(flat)) - at[row]] = flat
            none = pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary()), none, none, none, pa.nulls(len(size), pa.int64()), pa.nulls(len(size), pa.int32())], names=names)

    schema = STATE.format(label=rows.schema["label"].dataType.simpleString())
    names = ["id", "label", "v", "code", "upper", "lower", "error", "scans"]
    state, old, scans = materialize(rows.mapInArrow(lean(packed), schema), "codes-vectors"), None, []
    if len(first):
        for r in range(rounds + 1):
            state, before = materialize(passed(state, Book(old, books), r == rounds), "codes-state"), state
            discard(before)
            if kept is not None:
                scans.append(state.agg(F.sum("scans")).first()[0])
            if r < rounds:
                old, books = books, replaced(state, books)
    if kept is not None:
        kept += [books, scans]
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    group = F.struct(F.col("label").isNull().alias("none"), "label")
    sums = state.groupBy(group.alias("group")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = materialize(sums.withColumn("label_error", F.least("label_error", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")), "codes-labels")
    few = sums.limit(LABELS + 1).count() <= LABELS
    code = F.lower(F.concat_ws("", *(F.hex(F.substring("code", 2 * k + 1, 1)) for k in range(parts))))  # the low byte of each index
    out = state.withColumn("group", group)
    # one hot label is split among tasks by the engine's handling of skewed joins
    out = out.join(F.broadcast(sums) if few else sums, out["group"].eqNullSafe(sums["group"]))
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
