"""Shared pieces of the training-data operators: table access, materialised
tables in the cluster's shared folder, and vectorised word layout over Arrow text."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import fresh_path

#: Text handled at once by the vectorised passes; one longer text is taken alone.
BLOCK_BYTES = 1 << 20
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost
    executors lose nothing, and the shuffle files behind it can be dropped."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not every C library has it
    _trim = None


#: What workers keep between tasks of one operator, by its name.
caches: dict[str, dict] = {"bpe": {}}


def trim(keeps: str = "") -> None:
    """Give memory back to the machine that Arrow, the C library and the caches of other
    operators than `keeps` hold: workers live on between tasks and turn to other stages."""
    for name, cache in caches.items():
        if name != keeps:
            cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run, keeps: str = ""):
    """A stage over batches that leaves no memory behind."""

    def trimmed(batches):
        trim(keeps)
        try:
            yield from run(batches)
        finally:
            trim(keeps)

    return trimmed


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches sent to Python workers by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live plan refers to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row key (k1, k2): rows with one doc_id but other
    texts have other keys, and a null doc_id is a key like any other."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("k1"),
        F.xxhash64("text").alias("k2"),
    )


#: Bits of the map that marks rows to read again; at most half a megabyte whatever the data.
MARKS = 1 << 22


def marked(rows: DataFrame, wanted: DataFrame, by: str = "k2") -> DataFrame:
    """The rows whose key is marked in a bitmap of MARKS bits: all that `wanted` has and a few
    others, so a join needn't move the rest."""
    place = F.pmod(F.xxhash64(by), F.lit(MARKS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    marks = wanted.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("m"))
    every = rows.sparkSession.range(MARKS // 64).join(marks, "id", "left").select("id", F.coalesce("m", F.lit(0)).alias("m"))
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("b"))
    return rows.where(F.get(bitmap.scalar(), word.cast("int")).bitwiseAND(bit) != 0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES, rows: int = 1 << 20):
    """Row ranges of at most `most` bytes and `rows` rows, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), low + rows, n)
        yield low, high
        low = high


#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE):
    """Starts, ends and row number of each word; words end at a row's end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[buf]
    joined = np.zeros(n + 1, bool)  # joined[i]: bytes i-1 and i are of one word
    joined[1:n] = inside[1:] & inside[:-1]
    joined[off[(off > 0) & (off < n)]] = False
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed one by one.
LONG = 4096


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow the last byte."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand. Eight bytes
    a step go through a bijective finaliser, so spans of one length that differ in one step
    only have different hashes, and no pattern of bytes cancels as in a polynomial."""
    n = ends - starts
    h = mix(n.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    x, k = lanes(buf), 0
    at = np.flatnonzero((n > 0) & (n <= LONG))
    while len(at):
        lane, left = x[starts[at] + k], n[at] - k
        last = np.flatnonzero(left < 8)
        lane[last] &= (np.uint64(1) << (8 * left[last]).astype(np.uint64)) - np.uint64(1)
        h[at] = mix(h[at] ^ lane * np.uint64(0x9E3779B97F4A7C15))
        k += 8
        at = at[left > 8]
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hash(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each `width` (8 or more) consecutive bytes, by doubling; the two last
    halves may overlap."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, run = 8, mix(lanes(buf)[: len(buf) - 7] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width))
    while 2 * size <= width:
        run = joint(run[: len(run) - size], run[size:])
        size *= 2
    return run if size == width else joint(run[:n], run[width - size : width - size + n])


def joint(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of the pair, in order."""
    z = (x ^ (y + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32)) ^ x) * np.uint64(0xA0761D6478BD642F)
    return z ^ (z >> np.uint64(29))


def shingle_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; len(words)-k+1 of them. Runs of
    a power of two are made from halves, others from such runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, words, 1
    while True:
        if k & size:
            part = run[done : done + n]
            out = part if out is None else joint(out, part)
            done += size
        size *= 2
        if size > k:
            return mix(out)
        run = joint(run[: len(run) - size // 2], run[size // 2 :])


def planes(x: np.ndarray) -> bytes:
    """32-bit integers byte plane by byte plane, so that small ones compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def planes64(x: np.ndarray) -> bytes:
    """Non-negative integers byte plane by byte plane, as many planes as the largest needs."""
    x = np.ascontiguousarray(x).astype("<u8")
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes64(raw: bytes) -> np.ndarray:
    n = raw[0]
    out = np.zeros(((len(raw) - 1) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, offset=1).reshape(n, -1).T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers as their first and the distances."""
    return b"".join((x[:1].astype("<u8").tobytes(), planes64(np.diff(x)))) if len(x) else b""


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), unplanes64(raw[8:])]), dtype=np.uint64)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the intervals cover; touching ones join."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(starts) else ends
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1] if len(s) else e


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
