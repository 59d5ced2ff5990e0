"""Near-duplicate groups by SuperMinHash signatures.

Each element of a set deals its own permutation of the M signature places, step by step
(an incremental shuffle seeded by the element's hash), and offers the place of step j the
value j + r, r drawn from [0, 1). A place keeps the least value offered. As an element has
each rank j just once, its values over the places are correlated, and the share of equal
places varies less about the similarity than with independent hashes. Values of step j are
at least j, so a set is done as soon as all its places hold less: after few steps where it
has many elements. Steps are taken for many sets at once, in chunks of elements; a large
set goes from chunk to chunk with its places.

Bands of ROWS places are join keys. Equal sets are one class before; sets so small that
only equal ones are similar enough have no keys. Classes that share a key are candidates,
and what comes after is the parity-sketch join's: pairs are verified on their full sets,
all pairs of a crowded key included unless they are joined already, and links close to
groups by union-find in tasks and pointer jumping between them. At 0.85 a link is missed
in all 32 bands of four with a probability of 6e-11, whatever the number of candidates;
nothing else is left to chance, and no unverified pair links.

Defined results are those of `paritysketch.components`: a null text, or one without words,
has an empty set, links with nothing and is kept; fewer words than n make one shingle;
rows that repeat an id or a text are rows of their own; a row without an id links others
and is kept only where no row of its group has an id; texts of any length are whole sets;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import joint, mix
from folioforge.llm.paritysketch import Keys, components

N, NUMERATOR, DENOMINATOR = 3, 85, 100  # shingle length; least similarity as a fraction
PLACES, ROWS = 128, 4
CHUNK = 1 << 14  # elements that take their steps together


def signatures(h: np.ndarray, at: np.ndarray, places: int = PLACES) -> np.ndarray:
    """A row of `places` values (step << 32 | 32 random bits) for each set; the hashes of set
    i are h[at[i]:at[i + 1]], and no set is empty."""
    sets = len(at) - 1
    out = np.full((sets, places), np.uint64(places) << np.uint64(32), np.uint64)
    flat, of = out.reshape(-1), np.repeat(np.arange(sets), np.diff(at))
    for lo in range(0, len(h), CHUNK):
        seed, own = h[lo : lo + CHUNK], of[lo : lo + CHUNK]
        first, last = int(own[0]), int(own[-1]) + 1
        deal = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint32), (len(seed), 1))
        live = np.arange(len(seed))
        for j in range(places):
            x = mix(seed[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
            place = deal[live, k].astype(np.int64)
            deal[live, k] = deal[live, j]
            np.minimum.at(flat, own[live] * places + place, (x >> np.uint64(32)) + (np.uint64(j) << np.uint64(32)))
            open_ = out[first:last].max(1) >> np.uint64(32) > j
            live = live[open_[own[live] - first]]
            if not len(live):
                break
    return out


def bands(h: np.ndarray, at: np.ndarray, sets: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some of a block's sets, and the number among these of each key's set."""
    size = np.diff(at)[sets]
    some = np.flatnonzero(size * (q - p) >= p)  # below, one element more is too many
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = [h[at[i] : at[i + 1]] for i in sets[some]]
    x = signatures(np.concatenate(parts), np.concatenate([[0], np.cumsum(size[some])])).reshape(len(some), -1, ROWS)
    key = x[:, :, 0]
    for k in range(1, ROWS):
        key = joint(key, x[:, :, k])
    key = mix(key + np.arange(1, key.shape[1] + 1, dtype=np.uint64))
    return key.ravel(), np.repeat(some, key.shape[1])


BANDS = Keys(bands, lambda rows, elements: rows * (PLACES // ROWS) * 10)


def groups(docs: DataFrame, n: int = N, p: int = NUMERATOR, q: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) and kept of each row."""
    out = components(docs, n, p, q, BANDS)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
