"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference of a document is all text of smaller ids, cut into index blocks by the hash
of a seed, a run of `window` words. A block's index has, of each of its seeds, the place
where it first stands: the least document that has it and the word it begins at. Each
document is looked up in every block that a seed of it falls in, and the answers are put
together to places with a document and a word of the reference each. The parse is greedy:
a factor starts at a place with an answer and grows word by word along its reference
document while the next place stands one word on in the same one. Where it can't grow,
the windows that straddle its end are checked by their own answers, and the first of them
that has one opens the next factor, which may overlap the last. Factors are never shorter
than a window; the words that they cover are removed.

A block of documents finds the seeds that it has twice by itself: its least document is
the others' reference, and only that one's seeds are sent. So a seed that stands
everywhere is sent once a block, and answers go packed by groups of documents.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; a null or empty text has no
words; a row without an id is kept whole and is no reference; equal ids aren't smaller
than each other, so repeated rows keep the same words; of ties for a first place the one
of the least (id, word) counts; a text of any length is parsed whole; extra columns are
ignored; an empty table gives an empty result. Seeds are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import blocks, keyed, lean, materialize, mix, planes64, release, shingle_hash, span_hash, trim, tuned, unplanes64, utf8, word_spans

WINDOW = 13
BLOCK = 2 << 20  # text of a block of documents
SEED_BYTES = 20 << 20  # sent seeds that an index block is made for
GROUP_BYTES = 16 << 20  # text of the documents that a group of answers is made for
ANSWER = ("k1", "k2", "n", "gap", "ref", "shift")


def grouped(k1: np.ndarray, k2: np.ndarray, groups: int) -> np.ndarray:
    return (mix(k1.view(np.uint64) ^ mix(k2.view(np.uint64))) % np.uint64(groups)).astype(np.int64)


def zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def first_places(h: np.ndarray, k1: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each seed, the index of the one with the least id, then the least place."""
    order = np.lexsort((place, k1, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    out = np.empty(len(h), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def packed(target: np.ndarray, doc: np.ndarray, place: np.ndarray, k1: np.ndarray, k2: np.ndarray, more: dict) -> dict:
    """One row for each target: documents (rows of k1, k2), their places as distances, and
    further columns, each given with a function that packs it; document by document."""
    order = np.lexsort((place, doc, target))
    target, doc, place = target[order], doc[order], place[order]
    out = {c: [] for c in ("target", "k1", "k2", "n", "gap", *more)}
    full, cut = np.unique(target, return_index=True)
    for t, i, j in zip(full.tolist(), cut.tolist(), np.append(cut, len(target))[1:].tolist(), strict=True):
        there, first, n = np.unique(doc[i:j], return_index=True, return_counts=True)
        gap = np.diff(place[i:j], prepend=0)
        gap[first] = place[i:j][first]
        for c, v in (("target", t), ("k1", k1[there].tobytes()), ("k2", k2[there].tobytes()), ("n", planes64(n)), ("gap", planes64(gap)), *((c, pack(x[order[i:j]])) for c, (x, pack) in more.items())):
            out[c].append(v)
    return out


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k1 and k2 of the documents; of each place the document's number and the place."""
    n = np.concatenate([unplanes64(x) for x in pdf["n"]]).astype(np.int64)
    gap = np.concatenate([unplanes64(x) for x in pdf["gap"]]).astype(np.int64)
    walked, start = np.cumsum(gap), np.cumsum(n) - n
    place = walked - np.repeat(walked[start] - gap[start], n)
    return *(np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("k1", "k2")), np.repeat(np.arange(len(n)), n), place


def raw(x: np.ndarray) -> bytes:
    return x.tobytes()


def seeds(docs: DataFrame, window: int, buckets: int, groups: int) -> DataFrame:
    """Rows for each block of documents: seeds for an index block (target >= 0), and
    answers that the block gives itself for a group of documents (target -1 - group)."""
    names = ("target", "k1", "k2", "n", "gap", "h", "ref", "shift")

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(3))
            k1, k2 = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (1, 2))
            known = ~np.asarray(b.column(0).is_null())
            for lo, hi in blocks(off, BLOCK):
                part, at = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                s, e, row = word_spans(part, at)
                h = shingle_hash(span_hash(part, s, e), window)
                doc = row[: len(h)]
                place = np.arange(len(h)) - np.searchsorted(row, doc)
                inside = (doc == row[window - 1 :][: len(h)]) & known[lo + doc]
                h, doc, place = h[inside], doc[inside], place[inside]
                if not len(h):
                    continue
                a, c = k1[lo:hi], k2[lo:hi]
                first = first_places(h, a[doc], place)
                again = a[doc] > a[doc[first]]
                sent = ~again
                asks = packed((h[sent] % np.uint64(buckets)).astype(np.int64), doc[sent], place[sent], a, c, {"h": (h[sent], raw)})
                own = packed(-1 - grouped(a, c, groups)[doc[again]], doc[again], place[again], a, c, {"ref": (a[doc[first[again]]], raw), "shift": (place[first[again]] - place[again], lambda x: planes64(zigzag(x)))})
                for out in (asks, own):
                    if out["target"]:
                        empty = [None] * len(out["target"])
                        yield pa.RecordBatch.from_arrays([pa.array(out.get(c, empty), pa.int64() if c == "target" else pa.binary()) for c in names], names=list(names))

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(lean(run), "target long, " + ", ".join(f"{c} binary" for c in names[1:]))


def answered(pdf: pd.DataFrame, groups: int) -> pd.DataFrame:
    """The first place, in a smaller document, of each seed of one index block that has
    one: a row for each group of documents. Answers of blocks themselves pass."""
    target = pdf["target"].iloc[0]
    if target < 0:
        return pdf[list(ANSWER)].assign(grp=-1 - target)[["grp", *ANSWER]]
    trim()
    k1, k2, doc, place = unpacked(pdf)
    first = first_places(np.frombuffer(b"".join(pdf["h"]), np.uint64), k1[doc], place)
    again = k1[doc] > k1[doc[first]]
    ref, shift, doc, place = k1[doc[first[again]]], place[first[again]] - place[again], doc[again], place[again]
    out = packed(grouped(k1, k2, groups)[doc], doc, place, k1, k2, {"ref": (ref, raw), "shift": (shift, lambda x: planes64(zigzag(x)))})
    return pd.DataFrame(out).rename(columns={"target": "grp"})


def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a group: its factors, from all answers for it."""
    trim()
    k1, k2, doc, place = unpacked(pdf)
    ref = np.frombuffer(b"".join(pdf["ref"]), np.int64)
    shift = unzigzag(np.concatenate([unplanes64(x) for x in pdf["shift"]]))
    docs, number = np.unique(np.stack([k1, k2], 1), axis=0, return_inverse=True)
    doc = number.ravel()[doc]
    order = np.lexsort((place, doc))
    cut = np.searchsorted(doc[order], np.arange(len(docs) + 1))
    parsed = [factors(place[order[i:j]], ref[order[i:j]], shift[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame({"k1": docs[:, 0], "k2": docs[:, 1], **{c: [f[k].tobytes() for f in parsed] for k, c in enumerate(("start", "seeds", "ref", "ref_start"))}})


def factors(place: np.ndarray, ref: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy parse of one document from its places with an answer, in order: first word,
    number of seeds, reference document and first word there of each factor."""
    grows = (place[1:] == place[:-1] + 1) & (ref[1:] == ref[:-1]) & (shift[1:] == shift[:-1])
    first = np.concatenate([[0], np.flatnonzero(~grows) + 1])
    return place[first], np.diff(np.append(first, len(place))), ref[first], place[first] + shift[first]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, factors (words first to past, from word ref_first of
    document ref) and the kept text of each row."""
    spark = tuned(docs.sparkSession)
    rows = keyed(docs)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, groups = max(64, 2 * size // SEED_BYTES), max(32, size // GROUP_BYTES)  # some 12 bytes a word are sent
    answers = seeds(rows, window, buckets, groups).groupBy("target").applyInPandas(lambda pdf: answered(pdf, groups), "grp long, " + ", ".join(f"{c} binary" for c in ANSWER))
    marks = answers.groupBy("grp").applyInPandas(gathered, "k1 long, k2 long, start binary, seeds binary, ref binary, ref_start binary")
    marks = materialize(marks, "rlz-factors")
    release(spark)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "past", "ref", "ref_first")]))

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(1))
            out = {k: [] for k in ("n_words", "n_removed", "factors", "kept")}
            for i in range(b.num_rows):
                part = buf[off[i] : off[i + 1]]
                s, e, _ = word_spans(part, np.array([0, len(part)]))
                text = part.tobytes()
                parsed, keep = [], np.ones(len(s), bool)
                if b.column(2)[i].is_valid:
                    first, seeds_, ref, ref_first = (np.frombuffer(b.column(k)[i].as_py(), np.int64) for k in (2, 3, 4, 5))
                    past = first + seeds_ + window - 1
                    for x, y in zip(first.tolist(), past.tolist(), strict=True):
                        keep[x:y] = False
                    parsed = [dict(zip(("first", "past", "ref", "ref_first"), x, strict=True)) for x in zip(first.tolist(), past.tolist(), ref.tolist(), ref_first.tolist(), strict=True)]
                words = [text[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)]
                for name, v in (("n_words", len(s)), ("n_removed", int(len(s) - keep.sum())), ("factors", parsed), ("kept", b" ".join(words))):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["factors"], kind), pa.array(out["kept"], pa.binary()).cast(pa.string())], names=["doc_id", *out])

    schema = "doc_id long, n_words long, n_removed long, factors array<struct<first: long, past: long, ref: long, ref_first: long>>, kept string"
    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "start", "seeds", "ref", "ref_start").mapInArrow(lean(run), schema)
