"""Model providers. The defaults need no model and always give the same results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folioforge.functions.text import let
from folioforge.operators.vectors import overlap, unit

DIMS = 64


def bucket(word: Column, dims: int) -> Column:
    """The first 32 bits of the word's MD5, modulo dims: a hash that other engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")


def hashed(text: Column, dims: int = DIMS, normalise: bool = True) -> Column:
    """Bag of words hashed to buckets, of unit length if `normalise`; a blank text is the
    zero vector."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    counts = let(F.transform(words, lambda w: bucket(w, dims)), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(all_, lambda b: b == i)).cast("double")))
    return unit(counts) if normalise else counts


def batched(encode=None, batch: int = 64):
    """A pandas UDF over an encoder of lists of texts; blanks encode as one space, and a
    batch that fails gives zero vectors."""

    def default(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMS))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIMS] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    @pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode or default
        for s in parts:
            texts, rows = [t if t and t.strip() else " " for t in s], []
            for i in range(0, len(texts), batch):
                try:
                    rows += [r.tolist() for r in model(texts[i : i + batch])]
                except Exception:  # a provider's own failure, of any kind
                    rows += [[0.0] * DIMS] * len(texts[i : i + batch])
            yield pd.Series(rows)

    return run


def scored(score=None):
    """A score of (query, text) columns: the built-in overlap, or a scorer of lists of queries
    and texts, called once a batch, whose failure fails the query rather than hiding."""
    if score is None:
        return overlap

    @pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score([x or "" for x in q], [x or "" for x in t]), dtype=float)

    return run
