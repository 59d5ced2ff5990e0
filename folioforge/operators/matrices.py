"""Vectors compared block by block: matrix products first, exact sums where they decide.

A product of two blocks gives all their distances but for rounding. A bound on that error
tells which rows can't be among a query's k nearest; distances of the others are summed
component by component, in order, as SQL sums them, so that ranks and ties are exact.

Defined results: a squared distance goes over the components that both vectors have, and is
null where there are none (null and empty vectors); a cosine is 0 where one vector's norm
is, else null for two numbers of components or null ones. Nulls come last, NaN before them.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 256  # queries of a block that meet its rows at once, at most
PRODUCT = 1 << 22  # pairs of a product of two blocks, unless one query alone has more
TILE = 2048  # rows whose products with those queries are held at once
LISTED = 1 << 20  # pairs of a table where all pairs come out
PAIRS = 1 << 16  # pairs whose distances are summed at once
EPS = float(np.finfo(float).eps)


def chunks(n: int, rows: int, pairs: int) -> list[np.ndarray]:
    """n queries in turn, so many at once that they make at most so many pairs with the rows."""
    step = max(1, min(CHUNK, pairs // max(1, rows)))
    return [np.arange(lo, min(lo + step, n)) for lo in range(0, n, step)]


class Vectors:
    """Vectors of one length: components by place, which of them are there (None: all), which
    vectors are `given` at all, and which a product can be trusted with."""

    def __init__(self, at: np.ndarray, x: np.ndarray, there: np.ndarray, given: np.ndarray):
        self.at, self.x, self.there, self.given = at, x, None if there.all() else there, given
        with np.errstate(over="ignore", invalid="ignore"):
            self.plain = there.all(1) & (np.abs(x) < 1e100).all(1)
            self.norm = np.sqrt(fold(x.T, x.T))
            self.zero = given & there.all(1) & (self.norm == 0)
            self.sound = np.where(self.plain[:, None], x, 0.0)
            self.square = np.einsum("ij,ij->i", self.sound, self.sound)

    def take(self, i: np.ndarray) -> Vectors:
        return Vectors(self.at[i], self.x[i], self.present(self.x.shape[1])[i], self.given[i])

    def present(self, width: int) -> np.ndarray:
        return np.ones((len(self.x), width), bool) if self.there is None else self.there[:, :width]

    def cut(self, width: int) -> Vectors:
        return self if self.x.shape[1] == width else Vectors(self.at, self.x[:, :width], self.present(width), self.given)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two arrays of components summed in order, one component after another."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def by_length(column: pa.ChunkedArray, rows: np.ndarray | None = None) -> list[Vectors]:
    """The vectors of a column of lists of doubles (of some rows of it), by their lengths."""
    lists = one(column)
    at = np.arange(len(lists)) if rows is None else rows
    lists = lists if rows is None else lists.take(pa.array(rows))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values, there = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_valid().to_numpy(zero_copy_only=False)
    given, start, out = lists.is_valid().to_numpy(zero_copy_only=False), np.cumsum(size) - size, []
    for w in np.unique(size):
        mine = np.flatnonzero(size == w)
        i = start[mine][:, None] + np.arange(w)[None]
        out.append(Vectors(at[mine], np.where(there[i], values[i], 0.0), there[i], given[mine]))
    return out


def summed(q: Vectors, x: Vectors, i: np.ndarray, j: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared distances, or cosines, of pairs of rows i of q and j of x, and which are null."""
    value, none = np.zeros(len(i)), np.zeros(len(i), bool)
    alike, whole = q.x.shape[1] == x.x.shape[1], q.there is None and x.there is None
    w = min(q.x.shape[1], x.x.shape[1])
    q_there, x_there = (None, None) if whole else (q.present(w), x.present(w))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for lo in range(0, len(i), PAIRS):
            s = slice(lo, lo + PAIRS)
            a, b = q.x[i[s], :w].T, x.x[j[s], :w].T
            both = None if whole else (q_there[i[s]] & x_there[j[s]]).T
            if metric == "l2":
                d = a - b if whole else np.where(both, a - b, 0.0)
                value[s] = fold(d, d)
                none[s] = w == 0 if whole else ~both.any(0)
            else:
                zero = q.zero[i[s]] | x.zero[j[s]]
                value[s] = np.where(zero, 0.0, fold(a, b) / (q.norm[i[s]] * x.norm[j[s]]))
                none[s] = ~zero & (~(alike & q.given[i[s]] & x.given[j[s]]) | (False if whole else ~both.all(0)))
    return value, none


def units(v: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length 1, and which of them have a length to divide by."""
    long = v.plain & (v.norm > 1e-100)
    return v.sound / np.where(long, v.norm, 1.0)[:, None], long


def near(q: Vectors, x: Vectors, k: int, own: np.ndarray, mine: np.ndarray, metric: str, allowed=None, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x) of different ids that may be among each query's k nearest.
    `allowed`(lo, hi) says which pairs with those rows count at all (None: all of them), and
    `limit` above which squared distance none does. Rows come in tiles, each held against the
    k-th distance found so far."""
    w = q.x.shape[1]
    if metric == "l2":
        slack = 4 * (w + 8) * EPS
        trusted, asks, wide, theirs = x.plain, q.plain, 2 * (slack * q.square + 1e-290), slack * x.square + 1e-290
        a, b, base = -2 * q.sound, x.sound, x.square - theirs
    else:
        (b, trusted), (a, asks) = units(x), units(q)
        a, base, wide, theirs = -a, np.ones(len(b)), np.full(len(a), 16 * (w + 8) * EPS), np.zeros(len(b))
    most = np.full(len(a), np.inf) if limit is None else limit - q.square + wide
    every, odd = len(b) <= k, np.flatnonzero(~asks)
    best, i, j, v = np.full((len(a), k), np.inf), [], [], []
    for lo in range(0, len(b), TILE):
        s = slice(lo, min(lo + TILE, len(b)))
        mask = allowed(s.start, s.stop) if allowed else None
        if mask is not None and not mask.any():
            continue
        low = a @ b[s].T
        low += base[s]
        if mask is not None:
            low[~mask] = np.inf
        loose = np.flatnonzero(~trusted[s])
        low[:, loose] = np.inf
        if not every and not np.isfinite(best[:, -1]).all() and low.shape[1] > k:
            low[own[:, None] == mine[s][None]] = np.inf
            last = np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * theirs[s].max()
            kept = low <= np.minimum(last + wide, most)[:, None]
        else:
            kept = low <= np.minimum(best[:, -1] + wide, most)[:, None] if not every else low <= np.inf
        for rows, columns in ((slice(None), loose), (odd, slice(None))):
            kept[rows, columns] = True
        if mask is not None:
            kept &= mask
        at, of = np.divmod(np.flatnonzero(kept), kept.shape[1])
        other = own[at] != mine[of + lo]
        at, of = at[other], of[other]
        up = low[at, of] + 2 * theirs[of + lo]
        i.append(at), j.append(of + lo), v.append(up)
        if not every:
            new = first([at], k, [up])
            new = new[np.lexsort((up[new], at[new]))]
            nth = np.arange(len(new)) - np.searchsorted(at[new], at[new])
            more = np.full_like(best, np.inf)
            more[at[new], nth] = up[new]
            best = np.sort(np.concatenate([best, more], 1), axis=1)[:, :k]
    if not i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, v = (np.concatenate(p) for p in (i, j, v))
    sure = v - 2 * theirs[j] <= (best[:, -1] + wide)[i] if not every else np.ones(len(i), bool)
    kept = sure | ~trusted[j] | ~asks[i]
    return i[kept], j[kept]


def first(groups: list[np.ndarray], k: int, order: list[np.ndarray]) -> np.ndarray:
    """Which entries are the first k of their group in the order given (first key first)."""
    by = np.lexsort((*order[::-1], *groups[::-1]))
    new = np.zeros(len(by), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[by][1:] != g[by][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def codes(columns: list[pa.ChunkedArray], n: int) -> np.ndarray:
    """One number for each distinct tuple of values, in their order, nulls last."""
    out = np.zeros(n, np.int64)
    for c in columns:
        values = c.to_pylist()
        place = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
        out = out * (len(place) + 1) + np.array([place.get(v, len(place)) for v in values], np.int64)
    return out


def nearest(asked: pa.Table, rows: pa.Table, k: int, metric: str, keys: tuple[str, ...], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in `asked` (query_id, query, filter) and in `rows` (chunk_id, embedding,
    _filters) of the k nearest of each query and key, their distances and which are null. With
    `most`, of all keys together only the `most` most similar, ties in order of keys."""
    ids, numbers = np.unique(np.concatenate([np.array(t[c].to_pylist(), object if pa.types.is_string(t[c].type) else None) for t, c in ((rows, "chunk_id"), (asked, "query_id"))]), return_inverse=True)
    mine, own = numbers[: len(rows)], numbers[len(rows) :]
    key = codes([rows[c] for c in keys], len(rows))
    seen = {None: np.arange(len(rows))}
    wanted = asked["filter"].to_pylist() if "filter" in asked.column_names else [None] * len(asked)
    if any(f is not None for f in wanted):
        lists = one(rows["_filters"])
        parent, value = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        seen |= {f: np.unique(parent[value == f]) for f in set(wanted) - {None}}
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
    for f in dict.fromkeys(wanted):
        theirs = seen[f]
        stored = [v.take(np.flatnonzero(key[v.at] == c)) for v in by_length(rows["embedding"], theirs) for c in np.unique(key[v.at])]
        for every in by_length(asked["query"], np.flatnonzero(np.array([w == f for w in wanted]))):
            for some in chunks(len(every.at), max((len(x.at) for x in stored), default=0), PRODUCT):
                q, found = every.take(some), []
                for x in stored:
                    w = min(q.x.shape[1], x.x.shape[1])
                    a, b = (q.cut(w), x.cut(w)) if metric == "l2" else (q, x)
                    both = own[a.at], mine[b.at]
                    i, j = near(a, b, k, *both, metric) if a.x.shape[1] == b.x.shape[1] > 0 else np.nonzero(both[0][:, None] != both[1][None])
                    d, none = summed(a, b, i, j, metric)
                    d = d if metric == "l2" else 1 - d
                    i, j, d = a.at[i], b.at[j], np.where(none, 0.0, d)
                    s = first([i], k, [none, d, mine[j]])
                    found.append((i[s], j[s], d[s], none[s]))
                if not found:
                    continue
                i, j, d, none = (np.concatenate(p) for p in zip(*found, strict=True))
                s = first([i, key[j]], k, [none, d, mine[j]])
                i, j, d, none = i[s], j[s], d[s], none[s]
                if most is not None:
                    like = np.where(none | ~(d <= 1), 0.0, 1 - d)
                    s = first([i], most, [-like, key[j], none, d, mine[j]])
                    i, j, d, none = i[s], j[s], d[s], none[s]
                out.append((i, j, d, none))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def best(q: Vectors, x: Vectors, k: int, own: np.ndarray, mine: np.ndarray, allowed=None, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in q and x and squared distances of the k nearest of each query (own: the
    queries' ids, mine: the rows'), ties to the smaller id; `allowed`(queries, lo, hi) and
    `limit` as in `near`."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for some in chunks(len(q.at), len(x.at), PRODUCT):
        a = q.take(some)
        i, j = near(a, x, k, own[some], mine, "l2", allowed and (lambda lo, hi, some=some: allowed(some, lo, hi)), None if limit is None else limit[some])
        d, none = summed(a, x, i, j, "l2")
        s = first([i], k, [none, d, mine[j]])
        s = s[~none[s]]
        out.append((some[i[s]], j[s], d[s]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def rounded(value: np.ndarray, again, digits: int) -> np.ndarray:
    """Half up by decimals, as SQL rounds; `again` gives exact values of places so close to a
    half that the product's error could turn them."""
    scaled = np.abs(value) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5), value) / 10.0**digits + 0.0
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(close):
        step = decimal.Decimal(1).scaleb(-digits)
        out[close] = [float(decimal.Decimal(repr(float(v))).quantize(step, decimal.ROUND_HALF_UP)) + 0.0 for v in again(close)]
    return out


def cosines(asked: pa.Table, rows: pa.Table, digits: int):
    """Tables of query_id, chunk_id and their cosine, rounded, of all pairs of two ids."""
    for every in by_length(asked["query"]):
        for x in by_length(rows["embedding"]):
            b, far = units(x)
            ids = one(rows["chunk_id"]).take(pa.array(x.at))
            for some in chunks(len(every.at), len(x.at), LISTED):
                q = every.take(some)
                a, asks = units(q)
                n, m = len(q.at), len(x.at)
                value, none = np.zeros((n, m)), np.zeros((n, m), bool)
                alike = q.x.shape[1] == x.x.shape[1]
                if alike:
                    value = rounded((a @ b.T).ravel(), lambda p, q=q, x=x, m=m: summed(q, x, p // m, p % m, "cosine")[0], digits).reshape(n, m)
                i, j = np.nonzero(~(alike & asks[:, None] & far[None]))
                if len(i):
                    d, none[i, j] = summed(q, x, i, j, "cosine")
                    odd = ~np.isfinite(d)
                    value[i, j] = np.where(odd, d, rounded(np.where(odd, 0.0, d), lambda p, d=d: d[p], digits))
                own = one(asked["query_id"]).take(pa.array(np.repeat(q.at, m)))
                table = pa.table({"query_id": own, "chunk_id": ids.take(pa.array(np.tile(np.arange(m), n))), "similarity": pa.array(value.ravel(), mask=none.ravel())})
                yield table.filter(pc.not_equal(table["query_id"], table["chunk_id"]))
