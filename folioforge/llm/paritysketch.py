"""N-gram Jaccard join by parity sketches, and its components.

Two sets of sizes a <= b with Jaccard similarity of at least t differ in at most
d = (a + b)(1 - t)/(1 + t) elements. Sets meet in size bands; a band fixes d from its
largest sizes and cuts its bit sketch into d + 1 + s pieces. Each element flips one bit of
one piece, so the Hamming distance of two sketches is at most their symmetric difference
and linked sets agree in at least s + 1 pieces. A piece joins by a fingerprint of its
parity bits. Empty pieces say little and aren't joined on: a set with at most s of them
still has a piece with elements in common with each linked one. A set with more joins, as
the exact way for pairs of such sets, on its d + 1 elements of least hash too: the least
element that linked sets share is among these in both.

Equal sets are one class, found by a digest before any join. Classes that share a piece
become candidate pairs: all of a piece's classes if they are few. Of a crowded piece, each
class could meet the least class and its neighbour in an order that differs from piece to
piece; of these a class takes one least and one neighbour, however many crowded pieces it
has. A sketch of two to four bits an element bounds each pair's difference from below, as
pieces do, and drops nearly all that aren't similar enough. The others are verified on
their full sets: first each class with its least partner, then the pairs whose ends are
still apart. Last come all pairs of a crowded piece that lie in different components by
then: its classes are dealt to blocks, each two blocks meet in a task, and what the
sketches allow is verified, first each class with the partner of the nearest sketch, which
ties most families, then all that this leaves apart, so no pair that shares a piece is left
out. A verifying task passes on a spanning forest of its links, and these close to
components of least ids.

Pieces that a bounded sample of rows shows to be hot are dealt to tasks by class as well;
that changes where their pairs are found, not which.

Defined results: a null text, or one without words, has an empty set and links with
nothing; fewer words than n make one shingle; rows that repeat an id are rows of their
own; a row without an id links others, but lends no component id and gets the least id
of its component, or null; of ties for a representative the least (id, text hash) wins; a
text of any length is one set; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, blocks, discard, joint, keyed, lean, marked, materialize, mix, release, shingle_hash, span_hash, trim, tuned, utf8, word_spans

N, NUMERATOR, DENOMINATOR = 5, 80, 100  # shingle length; least similarity as a fraction
FEW, NEAR = 16, 1
PAIR, LEAST, BESIDE, CROWDED = range(4)  # kinds of what a bucket of keys finds
CROWD = 2048  # classes of a crowded piece in a block
SET_BYTES = 4 << 20  # full sets that a verifying task is made for
KEY_BYTES = 8 << 20  # piece keys that a bucket is made for
CELL_ROWS = 16384  # classes that a task of crowded pieces is made for
SAMPLE, HOT = 4096, 16  # rows sampled for hot pieces; rows of these that make a piece hot
SALTS = 64  # ways that a hot piece is dealt


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and offsets."""
    buf = LOWER[buf]
    s, e, row = word_spans(buf, off)
    w = span_hash(buf, s, e)
    h = shingle_hash(w, n)
    inside = row[: len(h)] == row[n - 1 :][: len(h)]
    h, first = h[inside], row[: len(h)][inside]
    rows = len(off) - 1
    words = np.bincount(row, minlength=rows)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        start = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = k < words[short]
            whole[more] = joint(whole[more], w[np.minimum(start + k, len(w) - 1)][more])
        h = np.concatenate([h, mix(whole ^ words[short].astype(np.uint64))])
        first = np.concatenate([first, short])
    order = np.lexsort((h, first))
    h, first = h[order], first[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (first[1:] != first[:-1])
    h, first = h[new], first[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(first, minlength=rows))])


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest of each set; that of an empty set is 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x1F83D9ABFB41BD6B)))])
    size = np.diff(at).astype(np.uint64)
    out = mix(joint(total[at[1:]] - total[at[:-1]], size))
    out[size == 0] = 0
    return out


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The parity sketch of each set: each element flips one bit. Its bits are a power of
    two from two to four times the elements, so a longer one folds to a shorter by halves."""
    size = np.diff(at)
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64)))
    base = np.concatenate([[0], np.cumsum(bits)])
    place = base[np.repeat(np.arange(len(size)), size)] + (h & (np.repeat(bits, size) - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little")
    return [raw[i:j].tobytes() for i, j in zip(base[:-1] // 8, base[1:] // 8, strict=True)]


def words_of(column: list[bytes]) -> np.ndarray:
    """Sketches of one length, a row of 64-bit words each."""
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), -1)


def folds(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def allowed(m, n, distance, p: int, q: int):
    """Whether sizes m and n and a lower bound of the difference allow similarity p/q."""
    return (np.minimum(m, n) * q >= np.maximum(m, n) * p) & (distance * (q + p) <= (m + n) * (q - p))


class Bands:
    """Size bands: the smaller set of a pair lies in [low[t], low[t + 1])."""

    def __init__(self, most: int, numerator: int, denominator: int):
        self.p, self.q = numerator, denominator
        low = [1]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, low[-1] * denominator // numerator))
        self.low = np.array(low)
        top = self.low[1:] - 1
        self.reach = top * denominator // numerator  # largest partner of a band's sets
        self.distance = (top + self.reach) * (denominator - numerator) // (denominator + numerator)
        self.slack = 2 + (self.distance + 1) // 8  # empty pieces that a set may have

    def of(self, size: int) -> range:
        """The bands in which a set of this size takes part."""
        own = int(np.searchsorted(self.low, size, "right")) - 1
        return range(int(np.searchsorted(self.reach, size)), own + 1)


def piece_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of one sorted set."""
    out = []
    for t in bands.of(len(h)):
        d, s = int(bands.distance[t]), int(bands.slack[t])
        if not d:
            continue  # only equal sets link here
        pieces = d + 1 + s
        piece = ((h >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)  # ascending, as h is
        first = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1])
        parity = np.bitwise_xor.reduceat(mix((h & np.uint64(0xFFFFFFFF)) + np.uint64(1)), first)  # a code of each bit of a 2^32-bit piece
        out.append(joint(parity, (piece[first] << np.uint64(20)) + np.uint64(2 * t)))
        if pieces - len(first) > s:
            out.append(joint(h[: d + 1], np.uint64(2 * t + 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(h: np.ndarray, at: np.ndarray, sets: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of some of a block's sets, and the number among these of each key's set."""
    bands = Bands(int(np.diff(at).max()), p, q)
    keys = [piece_keys(h[at[i] : at[i + 1]], bands) for i in sets]
    return np.concatenate(keys), np.repeat(np.arange(len(sets)), [len(k) for k in keys])


class Keys(NamedTuple):
    """What makes a block's join keys (as `pieces` does), and about how many bytes they have
    in all for so many rows and elements."""

    of: Callable
    size: Callable


PIECES = Keys(pieces, lambda rows, elements: 5 * elements)  # a key is 8 bytes and its owner; there is about one to two elements


def classed_keys(buf: np.ndarray, off: np.ndarray, n: int, p: int, q: int, keys: Keys):
    """Digests of the distinct sets of a block, the keys of all and whose each key is."""
    h, at = shingle_sets(buf, off, n)
    digest = digests(h, at)
    classes, first = np.unique(digest, return_index=True)
    first = first[classes != 0]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, owner = keys.of(h, at, first, p, q)
    return digest[first], key, owner


def hot_keys(rows: DataFrame, count: int, n: int, p: int, q: int, keys: Keys) -> np.ndarray:
    """Keys that at least HOT of some SAMPLE rows share; at most SAMPLE / HOT times the
    keys of a row, whatever the number of rows."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(0))
            for lo, hi in blocks(off):
                yield pa.RecordBatch.from_arrays([pa.array(classed_keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n, p, q, keys)[1].view(np.int64))], names=["key"])

    some = rows.where(F.pmod("k2", F.lit(max(1, count // SAMPLE))) == 0).select("text").mapInArrow(lean(run), "key long")
    found = some.groupBy("key").count().where(F.col("count") >= HOT).select("key").collect()
    return np.sort(np.array([r[0] for r in found], np.int64)).view(np.uint64)


def sketched(rows: DataFrame, buckets: int, hot: np.ndarray, n: int, p: int, q: int, keys: Keys) -> DataFrame:
    """One row for each block of documents and bucket of keys, classes once a block."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(0))
            for lo, hi in blocks(off, rows=60_000):
                digest, key, owner = classed_keys(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n, p, q, keys)
                salt = np.where(np.isin(key, hot), mix(digest)[owner] % np.uint64(SALTS), np.uint64(0))
                bucket = (mix(key + salt) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = key[order], owner[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                out = {c: [] for c in ("bucket", "classes", "key", "owner")}
                for k in np.flatnonzero(np.diff(cut)):
                    i, j = cut[k], cut[k + 1]
                    who, local = np.unique(owner[i:j], return_inverse=True)
                    for c, v in (("bucket", int(k)), ("classes", digest[who].tobytes()), ("key", key[i:j].tobytes()), ("owner", local.astype("<u2").tobytes())):
                        out[c].append(v)
                if out["bucket"]:
                    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("classes", "key", "owner"))], names=list(out))

    return rows.select("text").mapInArrow(lean(run), "bucket int, classes binary, key binary, owner binary")


def candidates(pdf: pd.DataFrame, hot: np.ndarray) -> pd.DataFrame:
    """What one bucket of keys finds, by `kind`. PAIR: two classes (a < b) of a key that few
    share. Of a key that is hot or that more than FEW share, LEAST: its least class and
    another; BESIDE: two neighbours; CROWDED: the key (a) and each of its classes (b)."""
    trim()
    size = np.array([len(c) // 8 for c in pdf["classes"]])
    base = np.repeat(np.cumsum(size) - size, [len(o) // 2 for o in pdf["owner"]])
    classes = np.frombuffer(b"".join(pdf["classes"]), np.int64)
    key = np.frombuffer(b"".join(pdf["key"]), np.uint64)
    owner = classes[base + np.frombuffer(b"".join(pdf["owner"]), "<u2")]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    found = {kind: np.zeros((0, 2), np.int64) for kind in (PAIR, LEAST, BESIDE, CROWDED)}

    def tied(k: np.ndarray, o: np.ndarray, most: int) -> np.ndarray:
        pairs = [found[PAIR][:0]]
        for step in range(1, most + 1):
            same = k[step:] == k[:-step]
            if not same.any():
                break
            pairs.append(np.stack([o[:-step][same], o[step:][same]], 1))
        return np.concatenate(pairs)

    _, start, count = np.unique(key, return_index=True, return_counts=True)
    many = (np.repeat(count, count) > FEW) | np.isin(key, hot)
    found[PAIR] = tied(key[~many], owner[~many], FEW - 1)
    if many.any():
        k, o = key[many], owner[many]
        least = np.repeat(owner[start], count)[many]
        found[LEAST] = np.stack([least, o], 1)[least != o]
        shuffled = np.lexsort((joint(o.view(np.uint64), k), k))
        found[BESIDE] = tied(k[shuffled], o[shuffled], NEAR)
        found[CROWDED] = np.stack([k.view(np.int64), o], 1)
    found |= {kind: np.unique(np.sort(found[kind], 1), axis=0) for kind in (PAIR, LEAST, BESIDE)}
    a, b = np.concatenate(list(found.values())).T
    return pd.DataFrame({"a": a, "b": b, "kind": np.repeat(list(found), [len(x) for x in found.values()])})


def first_pairs(found: DataFrame) -> DataFrame:
    """The pairs to verify before all of the crowded keys: those of keys that few share, and
    of a class's crowded keys one least class and one neighbour, so two a class at most."""
    order = F.when(F.col("kind") == LEAST, F.col("a")).otherwise(F.xxhash64("a", "b"))
    ties = found.where(F.col("kind").isin(LEAST, BESIDE)).groupBy("b", "kind").agg(F.min_by("a", order).alias("a"))
    return found.where(F.col("kind") == PAIR).select("a", "b").union(ties.select("a", "b")).distinct()


def crowded_pairs(crowd: DataFrame, classes: DataFrame, roots: DataFrame, p: int, q: int, nearest: bool = False) -> DataFrame:
    """All pairs (a < b) of a crowded key's classes that lie in different components and
    that sizes and sketches allow; with `nearest`, of these only each class's with the
    partner whose sketch differs least for the sizes. crowd: key and class."""
    there = materialize(crowd.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "jaccard-crowd")
    open_ = there.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key", "m", F.ceil(F.col("m") / CROWD).cast("int").alias("ways"))
    open_ = materialize(open_, "jaccard-open")
    rows = open_.agg(F.sum(F.col("m") * F.col("ways"))).first()[0]
    if not rows:
        discard(there, open_)
        return None
    mine = there.join(open_, "key").join(classes.select("class", "n", "sketch"), "class").withColumn("mine", F.pmod(F.xxhash64("class"), F.col("ways")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    met = met.withColumn("bucket", F.pmod(F.xxhash64("key", "x", "y"), F.lit(-(-rows // CELL_ROWS) * 4)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x", "y", "mine"])
        place = pdf[["key", "x", "y"]].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, [len(pdf)]])
        of, root, n, sketch = (pdf[c].to_numpy() for c in ("class", "root", "n", "sketch"))
        length = np.array([len(x) for x in sketch])
        left, same = (pdf["mine"] == pdf["x"]).to_numpy(), (pdf["x"] == pdf["y"]).to_numpy()
        out, far = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            mid = i if same[i] else i + int(left[i:j].sum())  # of one block both sides are the whole
            rows, columns = np.arange(i, j if same[i] else mid), np.arange(mid, j)
            for m in np.unique(length[rows]):
                for k in np.unique(length[columns]):
                    words = min(m, k) // 8
                    v = columns[length[columns] == k]
                    right = folds(words_of(sketch[v]), words)
                    whole = rows[length[rows] == m]
                    for lo in range(0, len(whole), 128):
                        u = whole[lo : lo + 128]
                        distance = np.zeros((len(u), len(v)), np.int64)
                        ok = (root[u, None] != root[v]) & allowed(n[u, None], n[v], 0, p, q)
                        if ok.any():
                            mine = folds(words_of(sketch[u]), words)
                            for w in range(words):
                                distance += np.bitwise_count(mine[:, w, None] ^ right[:, w])
                            ok &= allowed(n[u, None], n[v], distance, p, q)
                            if not nearest:
                                a, b = np.nonzero(ok)
                                out.append(np.stack([of[u[a]], of[v[b]]], 1))
                                continue
                            share = np.where(ok, distance / (n[u, None] + n[v]), np.inf)
                            for x, y, axis in ((u, v, 1), (v, u, 0)):
                                some = ok.any(axis)
                                out.append(np.stack([of[y[share.argmin(axis)[some]]], of[x[some]]], 1))
                                far.append(share.min(axis)[some])
        found = np.concatenate(out)
        if nearest:
            far = np.concatenate(far)
            order = np.lexsort((far, found[:, 1]))
            found, far = found[order], far[order]
            first = np.unique(found[:, 1], return_index=True)[1]
            return pd.DataFrame({"a": found[first, 0], "b": found[first, 1], "far": far[first]})
        found = np.unique(np.sort(found, 1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "far": 0.0})

    pairs = met.select("bucket", "key", "x", "y", "mine", "class", "root", "n", "sketch").groupBy("bucket").applyInPandas(compare, "a long, b long, far double")
    if nearest:
        pairs = pairs.groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a"))
    out = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-apart")
    discard(there, open_)
    return out


def plausible(pairs: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs that sizes and sketches allow to be similar enough."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    sizes = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"))
    fit = pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(least * q >= most * p).select("a", "b")

    def run(batches):
        for b in batches:
            a, c, na, nb = (b.column(i).to_numpy() for i in range(4))
            sa, sb = (np.array(b.column(i).to_pylist() or [b""], object) for i in (4, 5))
            la, lb = (np.array([len(x) for x in s[: len(a)]], np.int64) for s in (sa, sb))
            ok = np.zeros(len(a), bool)
            for m, k in np.unique(np.stack([la, lb], 1), axis=0):
                at = np.flatnonzero((la == m) & (lb == k))
                words = min(m, k) // 8
                distance = np.bitwise_count(folds(words_of(sa[at]), words) ^ folds(words_of(sb[at]), words)).sum(1, dtype=np.int64)
                ok[at] = allowed(na[at], nb[at], distance, p, q)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], names=["a", "b"])

    return fit.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Links among the pairs, by their full sets: of each task a spanning forest. Pairs are
    dealt by their hub a, a large hub's to several tasks; each set goes straight from one
    text of its class to the tasks that ask for it."""
    sizes = lambda c: classes.select(F.col("class").alias(c), (8 * F.col("n")).alias(f"n{c}"))
    weighed = materialize(pairs.join(sizes("a"), "a").join(sizes("b"), "b"), "jaccard-weighed")
    hubs = weighed.groupBy("a").agg(F.max("na").alias("own"), F.ceil(F.sum("nb") / SET_BYTES).cast("long").alias("ways"))
    size = (weighed.agg(F.sum("nb")).first()[0] or 0) + (hubs.agg(F.sum(F.col("own") * F.col("ways"))).first()[0] or 0)  # as sent, each set once a task
    deal = max(1, -(-size // SET_BYTES))
    dealt = weighed.join(hubs, "a").withColumn("block", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("ways"))), F.lit(deal)))
    dealt = materialize(dealt.select("block", "a", "b"), "jaccard-pairs")
    needed = dealt.select("block", F.col("a").alias("class")).union(dealt.select("block", F.col("b").alias("class")))
    homes = needed.groupBy("class").agg(F.collect_set("block").alias("homes"))
    wanted = materialize(classes.join(homes, "class").select("class", "one.*", "homes"), "jaccard-wanted")

    def sets(batches):
        for b in batches:
            buf, off = utf8(b.column(2))
            for lo, hi in blocks(off):
                h, at = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["class", "homes", "set"])

    found = marked(rows, wanted).join(wanted, ["k1", "k2"]).select("class", "homes", "text").mapInArrow(lean(sets), "class long, homes array<long>, set binary")
    sent = found.select(F.explode("homes").alias("home"), "class", "set")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trim()
        of = {c: np.frombuffer(s, np.uint64) for c, s in zip(right["class"], right["set"], strict=True)}
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            u, v = of[x], of[y]
            both = np.concatenate([u, v])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok[i] = q * common >= p * (len(u) + len(v) - common)
        a, b = forest(a[ok], b[ok])
        return pd.DataFrame({"a": a, "b": b})

    out = materialize(dealt.groupBy("block").cogroup(sent.groupBy("home")).applyInPandas(check, "a long, b long"), "jaccard-links")
    discard(weighed, dealt, wanted)
    return out


def hooks(pairs: DataFrame) -> DataFrame:
    """Each class with its least candidate partner, if that is less: at most one a class."""
    ways = pairs.select(F.col("b").alias("v"), F.col("a").alias("w"))  # a < b
    return ways.groupBy("v").agg(F.min("w").alias("a")).select("a", F.col("v").alias("b"))


def linked(pairs: DataFrame, crowd: DataFrame, rows: DataFrame, classes: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Links that join all that any of the pairs, or any two classes of a crowded key, join.
    First each class is tried with its least partner; then all other pairs that this leaves
    in different components. The crowded keys follow: each class with its nearest partner,
    then all pairs that are still apart."""
    first = materialize(hooks(pairs), "jaccard-hooks")
    near = verified(first, rows, classes, n, p, q)
    roots = closed(near)
    side = lambda c: roots.select(F.col("class").alias(c), F.col("root").alias(f"r{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = materialize(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "jaccard-rest")
    if not rest.isEmpty():
        near = near.union(verified(rest, rows, classes, n, p, q))
        discard(roots)
        roots = closed(near)
    discard(first, rest)
    for nearest in (True, False):
        apart = crowded_pairs(crowd, classes, roots, p, q, nearest)
        if apart is None or apart.isEmpty():
            break
        near = near.union(verified(apart, rows, classes, n, p, q))
        discard(apart, roots)
        roots = closed(near)
    return roots


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join what earlier ones leave apart."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[y], keep[i] = x, True
    return a[keep], b[keep]


def closed(links: DataFrame) -> DataFrame:
    """(class, root) of each end of the links; equal roots are one component. Each round
    takes the least root of the neighbours and then the root's own root."""
    both = materialize(links.select(F.col("a").alias("class"), F.col("b").alias("w")).union(links.select(F.col("b").alias("class"), F.col("a").alias("w"))).distinct(), "links")
    roots = materialize(both.groupBy("class").agg(F.min("w").alias("m")).select("class", F.least("class", "m").alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.where("moved").isEmpty():
        near = both.join(roots.select(F.col("class").alias("w"), "root"), "w").groupBy("class").agg(F.min("root").alias("m"))
        step = roots.join(near, "class").select("class", "root", F.least("root", "m").alias("m"))
        jump = roots.select(F.col("class").alias("m"), F.col("root").alias("up"))
        step = step.join(jump, "m").select("class", "root", F.col("up").alias("m"))
        step = materialize(step.join(jump, "m").select("class", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        discard(roots)
        roots = step
    discard(both)
    return roots


def classed(rows: DataFrame, n: int = N) -> DataFrame:
    """doc_id, k1, k2, n_shingles, class (0: empty set) and sketch of each row."""

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(3))
            for lo, hi in blocks(off):
                h, at = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:3]), pa.array(np.diff(at)), pa.array(digests(h, at).view(np.int64)), pa.array(sketches(h, at), pa.binary())], names=["doc_id", "k1", "k2", "n_shingles", "class", "sketch"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(lean(run), "doc_id long, k1 long, k2 long, n_shingles long, class long, sketch binary")


def labelled(docs: DataFrame, n: int = N, p: int = NUMERATOR, q: int = DENOMINATOR, keys: Keys = PIECES) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, n_shingles, class) and distinct classes (class, root, least)."""
    spark = tuned(docs.sparkSession)
    rows = keyed(docs)
    every = materialize(classed(rows, n), "jaccard-classes")
    classes = every.where("class != 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("one"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    classes = materialize(classes, "jaccard-distinct")
    count, elements = every.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    hot = hot_keys(rows, count, n, p, q, keys)
    buckets = max(64, keys.size(count, elements) // KEY_BYTES)
    found = materialize(sketched(rows, buckets, hot, n, p, q, keys).groupBy("bucket").applyInPandas(lambda pdf: candidates(pdf, hot), "a long, b long, kind int"), "jaccard-found")
    release(spark)
    pairs = materialize(plausible(first_pairs(found), classes, p, q), "jaccard-candidates")
    crowd = found.where(F.col("kind") == CROWDED).select(F.col("a").alias("key"), F.col("b").alias("class"))
    roots = linked(pairs, crowd, rows, classes, n, p, q)
    discard(found, pairs)
    release(spark)
    rooted = classes.join(roots, "class", "left")
    return every, rooted.select("class", F.coalesce("root", "class").alias("root"), "least", "one")


def components(docs: DataFrame, n: int = N, p: int = NUMERATOR, q: int = DENOMINATOR, keys: Keys = PIECES) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id that links reach, of each row."""
    every, classes = labelled(docs, n, p, q, keys)
    ids = classes.join(classes.groupBy("root").agg(F.min("least").alias("component")), "root").select("class", "component")
    out = every.join(ids, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def survivors(docs: DataFrame, n: int = N, p: int = NUMERATOR, q: int = DENOMINATOR) -> DataFrame:
    """docs with one row of each component, that of the least id; rows without words all stay."""
    every, classes = labelled(docs, n, p, q)
    first = classes.groupBy("root").agg(F.min("one").alias("one")).select("one.*")
    kept = first.union(every.where("class = 0").select("k1", "k2").distinct())
    text, names = F.col("text").cast("string"), docs.columns
    keys = docs.withColumn("_k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1))).withColumn("_k2", F.xxhash64(text))
    kept = kept.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    return keys.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*names)
