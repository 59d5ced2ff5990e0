"""Suffix-array dedup of byte strings by blockwise construction with a cover sample.

Suffixes matter to a depth of `length` bytes. Each is put in a bucket by its anchor, the
least hashed gram among its first `length` bytes, and its distance to it: equal strings
have equal anchors at equal distances. A run of suffixes with one anchor and the bytes
they cover is a context. Buckets of grams that stand alone hold no repeat; a context that
stands more than once, byte for byte, is repeated as a whole. Only contexts between these
are sorted: block by block, with their anchors laid at multiples of V, so that any two
suffixes of one bucket differ by a multiple of V and one residue covers all differences.
The sample of that residue is ranked first, by its first V bytes and then by doubling, to
a fixed depth. The suffixes of a bucket are then sorted by the fingerprints of the few
bytes before and after the ranked stretch and by the rank that settles the long tie. So
memory is bounded by the block, and no comparison goes deeper than V bytes.

Grams with more than `most` different contexts go the other exact way: their suffixes
meet by fingerprint of all their bytes, counted before and after the shuffle.

Defined results: a null text is empty; rows that repeat an id and text are places of
their own, so both lose what they share; texts shorter than `length` are kept whole;
rows without an id are rows like any other; matches lie in one text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import BLOCK_BYTES, blocks, covered, discard, joint, keyed, lean, materialize, mix, release, span_hash, trim, tuned, utf8, window_hash

LENGTH, GRAM, V = 400, 64, 32
MOST = 1024
BLOCK = 4 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    size, run = 1, x
    while 2 * size <= width:
        run = np.minimum(run[: len(run) - size], run[size:])
        size *= 2
    return np.minimum(run[: len(x) - width + 1], run[width - size : width - size + len(x) - width + 1])


def runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(row, first suffix, number of suffixes, anchor's distance, gram, context) of each
    run of suffixes that share an anchor; places are relative to the row."""
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    n = len(buf) - length + 1
    if n <= 0:
        return empty
    grams = window_hash(buf, gram)
    at = np.arange(len(grams))
    least = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[:n] == row[length - 1 :]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])
    s = np.flatnonzero(first)
    if not len(s):
        return empty
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    e = np.flatnonzero(last)
    a = anchor[s]
    context = joint(span_hash(buf, s, e + length), (a - s).astype(np.uint64))
    return [row[s], s - off[row[s]], e - s + 1, a - s, grams[a], context]


def anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            for lo, hi in blocks(off, BLOCK_BYTES // 2):
                row, s, n, d, g, c = runs(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length, gram)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(s), pa.array(n), pa.array(d), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["k1", "k2", "s", "n", "d", "g", "c"])

    return rows.select("k1", "k2", "text").mapInArrow(lean(run), "k1 long, k2 long, s long, n long, d long, g long, c long")


def cover_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the sample suffixes (every V-th) by their first `depth` bytes, a multiple of V."""
    blocks_ = np.ascontiguousarray(x[: len(x) // V * V].reshape(-1, V)).view(">u8").astype(np.uint64)
    order = np.lexsort(blocks_.T[::-1])
    step = (blocks_[order][1:] != blocks_[order][:-1]).any(1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(step)])
    size, out, done = V, None, 0
    joined = lambda p, q: np.unique(p * (q.max(initial=0) + 1) + q, return_inverse=True)[1]
    shifted = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, len(r)), np.int64)])
    while True:
        if depth & size:
            out = rank if out is None else joined(out, shifted(rank, done // V))
            done += size
        if 2 * size > depth:
            return out
        rank = joined(rank, shifted(rank, size // V))
        size *= 2


def repeated(texts: list[bytes], group: np.ndarray, n: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix (the first n of each context, in order) stands in another
    context of its group at the same distance from the anchor with equal `length` bytes."""
    size = np.array([len(t) for t in texts])
    lead = -d % V  # anchors come to lie at multiples of V
    room = (lead + size + length + 2 * V) // V * V
    base = np.cumsum(room) - room + lead
    x = np.zeros(int(room.sum()) + length, np.uint8)
    for b, t in zip(base.tolist(), texts, strict=True):
        x[b : b + len(t)] = np.frombuffer(t, np.uint8)
    which = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = base[which] + nth
    out = np.zeros(len(at), bool)
    bucket = joint(group[which], (nth - d[which]).astype(np.uint64))

    def shared(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        back = np.empty(len(k), bool)
        back[order] = same
        return back

    left = np.flatnonzero(shared(bucket))
    if not len(left):
        return out
    depth = (length - V) // V * V
    rank = cover_ranks(x, depth)
    p = at[left]
    sample = -(-p // V) * V
    ends = joint(span_hash(x, p, sample), span_hash(x, sample + depth, p + length))
    out[left] = shared(joint(joint(bucket[left], ends), mix(rank[sample // V].astype(np.uint64))))
    return out


def spans_of(flags: np.ndarray, n: np.ndarray, s: np.ndarray, length: int):
    """(context, start, end) of the maximal runs of flagged suffixes."""
    which = np.repeat(np.arange(len(n)), n)
    first, last = flags.copy(), flags.copy()
    border = which[1:] != which[:-1]
    first[1:] &= ~flags[:-1] | border
    last[:-1] &= ~flags[1:] | border
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + s[which]
    i, j = np.flatnonzero(first), np.flatnonzero(last)
    return which[i], place[i], place[j] + length


def contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts: wanted has k1, k2, s, n, d, g, alone, n_contexts."""
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "n", "d", "g", "alone", "hot")).alias("asked"))
    names = ("s", "n", "d", "g", "alone", "hot")

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            lists = b.column(3)
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            column = {c: flat.field(c) for c in names}
            row = np.repeat(np.arange(len(count)), count)
            start = off[row] + column["s"].to_numpy()
            end = start + column["n"].to_numpy() + length - 1
            for i in range(0, len(row), 4096):
                take = pa.array(row[i : i + 4096])
                texts = [buf[x:y].tobytes() for x, y in zip(start[i : i + 4096].tolist(), end[i : i + 4096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(column[c].slice(i, 4096) for c in names), pa.array(texts, pa.binary())], names=["k1", "k2", *names, "t"])

    return rows.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(lean(run), "k1 long, k2 long, s long, n long, d long, g long, alone boolean, hot boolean, t binary")


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """k1, k2, start and end of intervals that cover just the bytes of repeated strings; and
    the tables that they are read from."""
    spark = rows.sparkSession
    anchors = materialize(anchored(rows, length, gram), "suffix-anchors")
    classes = anchors.groupBy("g", "c").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "s", "n", "d")).alias("one"))
    classes = materialize(classes, "suffix-classes")
    whole = anchors.join(classes.where("times > 1").select("g", "c"), ["g", "c"], "left_semi").select("k1", "k2", F.col("s").alias("start"), (F.col("s") + F.col("n") + length - 1).alias("end"))
    mixed = classes.groupBy("g").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    wanted = classes.join(mixed, "g").select("one.*", "g", (F.col("times") == 1).alias("alone"), (F.col("kinds") > most).alias("hot"))
    texts = materialize(contexts(rows, wanted, length), "suffix-contexts")
    release(spark)
    size = texts.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    deal = max(1, -(-size // BLOCK))

    def sort_block(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        n, d, s = (pdf[c].to_numpy() for c in ("n", "d", "s"))
        flags = repeated(list(pdf["t"]), pdf["g"].to_numpy().view(np.uint64), n, d, length)
        i, start, end = spans_of(flags & np.repeat(pdf["alone"].to_numpy(), n), n, s, length)
        return pd.DataFrame({"k1": pdf["k1"].to_numpy()[i], "k2": pdf["k2"].to_numpy()[i], "start": start, "end": end})

    schema = "k1 long, k2 long, start long, end long"
    block = F.pmod(F.xxhash64("g"), F.lit(deal))
    sorted_ = texts.where("not hot").withColumn("block", block).groupBy("block").applyInPandas(sort_block, schema)

    def prints(batches):
        for b in batches:
            buf, off = utf8(b.column(5))
            n, d, s, g = (b.column(i).to_numpy() for i in (3, 4, 2, 6))
            which = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            for lo in range(0, len(which), 1 << 18):
                w, k = which[lo : lo + (1 << 18)], nth[lo : lo + (1 << 18)]
                part = buf[off[w[0]] : off[w[-1] + 1]]
                at = off[w] - off[w[0]] + k
                f = joint(joint(window_hash(part, length)[at], (k - d[w]).astype(np.uint64)), g[w].view(np.uint64))
                take = pa.array(w)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(s[w] + k), b.column(7).take(take), pa.array(f.view(np.int64))], names=["k1", "k2", "start", "alone", "f"])

    printed = texts.where("hot").select("k1", "k2", "s", "n", "d", "t", "g", "alone").mapInArrow(lean(prints), "k1 long, k2 long, start long, alone boolean, f long")
    again = printed.groupBy("f").agg(F.count("*").alias("times")).where("times > 1").select("f")
    hot = printed.where("alone").join(again, "f", "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(sorted_).unionByName(hot), [anchors, classes, texts]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, keep: tuple[str, ...] = ("doc_id",), characters: bool = False) -> DataFrame:
    """The `keep` columns, n_bytes, n_removed, spans (start, end) and the kept bytes of
    each row. With `characters`, only whole characters go, so what stays is UTF-8."""
    spark = tuned(docs.sparkSession)
    rows = keyed(docs)
    spans, parts = repeated_spans(rows, length, gram, most)
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    discard(*parts)
    release(spark)
    kept = [f"{c} {t}" for c, t in docs.select(*keep).dtypes]
    schema = ", ".join([*kept, "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"])
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(len(keep)))
            out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
            for i, asked in enumerate(b.column(len(keep) + 1)):
                part = buf[off[i] : off[i + 1]]
                mark, s, e = part, np.zeros(0, np.int64), np.zeros(0, np.int64)
                if asked.is_valid:
                    s, e = covered(*(asked.values.field(c).to_numpy() for c in ("start", "end")))
                    if characters:
                        s, e = whole_characters(part, s, e)
                    change = np.zeros(len(part) + 1, np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, e, -1)
                    mark = part[np.cumsum(change[:-1]) == 0]
                for name, v in (("n_bytes", len(part)), ("n_removed", len(part) - len(mark)), ("spans", [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]), ("kept", mark.tobytes())):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pair), pa.array(out["kept"], pa.binary())], names=[*keep, *out])

    text = F.col("text").cast("string")
    left = docs.select(*keep, text.alias("_t"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("k1"), F.xxhash64(text).alias("k2"))
    return left.join(spans, ["k1", "k2"], "left").select(*keep, "_t", "spans").mapInArrow(lean(run), schema)


def whole_characters(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without characters that they cover in part only."""
    s, e = s.copy(), e.copy()
    inner = np.append((part & 0xC0) == 0x80, False)
    for _ in range(3):
        s = np.where((s < e) & inner[s], s + 1, s)
        e = np.where((s < e) & inner[e], e - 1, e)
    ok = s < e
    return s[ok], e[ok]
