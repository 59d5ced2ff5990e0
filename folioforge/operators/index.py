"""An inverted-file index for vector search: approximate by codes, exact by bounds.

The lists' centres are fitted by k-means on a bounded sample, and so are codebooks for the
parts of the residuals (a row less its centre). Every row is indexed: under its nearest
centre, with its distance from it and a code of one byte for each four components. An
approximate search compares the vectors that codes stand for, in the lists whose centres are
nearest to the query, and reads the vectors of the `kept` x k rows that are nearest by them,
whose true distances then count. The exact way looks through the nearest lists and goes on
from there: a list can hold a nearer row only if the query's distance to the centre less the
list's radius is below the k-th distance found, and a row only if its own distance to the
centre differs from the query's by less, so the rest is passed over by the triangle
inequality and nothing is missed. Rows that no bound holds for (numbers missing or not
finite) are always compared.

Lists are packed to shelves of a bounded number of rows, a list with more has several, and
queries are dealt to blocks. A block and a shelf that any of its queries visits are compared
as matrices (`matrices.py`) in a group of their own; which lists of the shelf a query looks
through is found there, so visits of lists are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from folioforge.operators import matrices
from folioforge.operators.vectors import blocks, grouped, ranked, squared_l2, tasks
from folioforge.session import fresh_path

SAMPLE = 20_000  # rows that the centres are fitted on, at most
LISTS = 4096  # lists, at most
PART, BLOCK = 65_536, 65_536  # rows of a shelf, and queries on it, in a group, at most
LEAST = 4096  # rows of a shelf, where there are tasks for more shelves
BYTES = 32 << 20  # of the vectors of a shelf
ROUNDS = 12
WIDTH, ENTRIES = 4, 256  # components and codebook entries of a part of a residual
INDEX = "chunk_id long, list int, away double, embedding array<double>"
CODES = "chunk_id long, list int, code binary"
VISITS = "query_id long, query array<double>, near array<int>, shelves array<int>"
INTS = pa.list_(pa.int32())
LOOSE = 1e-12  # of distances that were not summed exactly, by the size of the numbers


class Index(NamedTuple):
    centres: np.ndarray
    books: np.ndarray  # parts x entries x WIDTH
    rows: DataFrame  # as in INDEX; away is NaN where no bound holds
    codes: DataFrame  # as in CODES
    lists: DataFrame  # list, n, parts, radius


class Shelves(NamedTuple):
    first: np.ndarray  # the first shelf of each list
    parts: np.ndarray  # and how many it has
    radius: np.ndarray
    count: int


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x to each of y."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]
    return np.sqrt(np.maximum(d, 0))


def means(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of the rows of x, or as many as there are rows."""
    rnd = np.random.default_rng(1)
    c = x[np.sort(rnd.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(ROUNDS):
        near = nearest_of(x, c)
        n, total = np.bincount(near, minlength=len(c)), np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1)[None] / 2
    return np.concatenate([(half - x[i : i + 512] @ c.T).argmin(1) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.int64)


def between(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each row of x to each of y, the least and largest that rounding leaves."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d, slack = square - 2 * (x @ y.T), 4 * (x.shape[1] + 8) * matrices.EPS * square
    return np.sqrt(np.maximum(d - slack, 0)), np.sqrt(np.maximum(d + slack, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; missing numbers are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), len(flat) // len(column))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, INTS) if k in ("near", "shelves") else pa.array(v) for k, v in columns.items()})


def split(x: np.ndarray) -> np.ndarray:
    """Rows cut into parts of WIDTH components, filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def fitted(vectors: DataFrame, lists: int | None, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and codebooks from a sample of the rows, those of least hash; by default four
    times the root of the number of rows as lists."""
    if lists is None:
        lists = min(LISTS, max(1, int(4 * vectors.count() ** 0.5)))
    some = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").collect()
    if not some:
        return np.zeros((0, 0)), np.zeros((0, 0, WIDTH))
    x = np.array([r.embedding for r in some], float)
    sound = (np.abs(x) < 1e100).all(1)
    x = x[sound] if sound.any() else np.zeros_like(x[:1])
    c = means(x, lists)
    rest = split(x - c[nearest_of(x, c)])
    return c, np.stack([means(rest[:, m], ENTRIES) for m in range(rest.shape[1])])


def built(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Index rows of chunk_id and embedding (all of one length), written to the shared folder;
    rows without an id or vector, which no search finds, are left out."""
    spark = vectors.sparkSession
    vectors = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    c, books = fitted(vectors, lists, sample)
    sent = spark.sparkContext.broadcast((c, books))

    def placed(batches):
        for b in batches:
            if not len(b):
                continue
            c, books = sent.value
            x = matrix(b["embedding"])
            sound = (np.abs(x) < 1e100).all(1)
            x = np.where(sound[:, None], x, 0.0)
            at = nearest_of(x, c)
            rest = x - c[at]
            parts = split(rest)
            code = np.stack([nearest_of(parts[:, m], books[m]) for m in range(len(books))], 1).astype(np.uint8)
            away = np.where(sound, np.sqrt((rest**2).sum(1)), np.nan)
            yield batch(chunk_id=b["chunk_id"], list=at.astype(np.int32), away=away, embedding=b["embedding"], code=[r.tobytes() for r in code])

    path, lists_path, schema = fresh_path(spark, "index"), fresh_path(spark, "index-lists"), INDEX + ", code binary"
    vectors.repartition(tasks(spark), "chunk_id").mapInArrow(placed, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    sizes.write.parquet(lists_path)
    return Index(c, books, rows.drop("code"), rows.select("chunk_id", "list", "code"), spark.read.schema(sizes.schema).parquet(lists_path))


def shelved(index: Index, least: int) -> Shelves:
    """Lists, LISTS at most, in turn on shelves, `least` of them if there are rows enough."""
    found = {r["list"]: r for r in index.lists.collect()}
    total, k = sum(r.n for r in found.values()), len(index.centres)
    room = max(1, min(PART, BYTES // (8 * max(1, index.centres.shape[-1])), max(LEAST, -(-total // least))))
    first, parts, radius = np.zeros(k, np.int32), np.zeros(k, np.int32), np.zeros(k)
    at, left = -1, 0
    for i in sorted(found):
        n, radius[i] = found[i].n, found[i].radius
        if n > left:
            first[i], parts[i] = at + 1, -(-n // room)
            at, left = at + int(parts[i]), room - n if n < room else 0
        else:
            first[i], parts[i], left = at, 1, left - n
    return Shelves(first, parts, radius, at + 1)


def standing(shelves: Shelves, wanted: np.ndarray) -> list[np.ndarray]:
    """The shelves of the lists that each query wants."""
    out = np.zeros((len(wanted), shelves.count), bool)
    for i in range(int(shelves.parts.max(initial=0))):
        q, at = np.nonzero(wanted & (shelves.parts > i)[None])
        out[q, shelves.first[at] + i] = True
    return [np.flatnonzero(r).astype(np.int32) for r in out]


def ruled(shelves: Shelves, low: np.ndarray, size: np.ndarray, limit: np.ndarray, lists: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Lists that can't hold a row within each query's limit; low: the least distances to
    their centres, size: of the numbers compared."""
    return low - shelves.radius[lists][None] > (limit * (1 + 1e-9))[:, None] + LOOSE * (size + shelves.radius[lists][None])


def visits(index: Index, queries: DataFrame, shelves: Shelves, probes: int) -> DataFrame:
    """As in VISITS: the nearest lists of each query and their shelves."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, shelves))

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.slice(lo, 256)
                c, shelves = sent.value
                d = apart(matrix(some["query"]), c) if len(c) else np.zeros((len(some), 0))
                near = d.argsort(1, kind="stable")[:, :probes].astype(np.int32)
                wanted = np.zeros(d.shape, bool)
                np.put_along_axis(wanted, near, True, 1)
                yield batch(query_id=some["query_id"], query=some["query"], near=list(near), shelves=standing(shelves, wanted))

    return queries.select("query_id", "query").mapInArrow(run, VISITS)


def others(index: Index, asked: DataFrame, shelves: Shelves) -> DataFrame:
    """As in VISITS and `limit`: the shelves of the lists beyond `near` that the limit, a
    distance or infinite, doesn't rule out."""
    sent = asked.sparkSession.sparkContext.broadcast((index.centres, shelves))

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.slice(lo, 256)
                c, shelves = sent.value
                low, high = between(matrix(some["query"]), c) if len(c) else (np.zeros((len(some), 0)),) * 2
                wanted = ~ruled(shelves, low, high, some["limit"].to_numpy(zero_copy_only=False))
                np.put_along_axis(wanted, matrix(some["near"]).astype(np.int64), False, 1)
                yield batch(query_id=some["query_id"], query=some["query"], near=some["near"], shelves=standing(shelves, wanted), limit=some["limit"])

    return asked.select("query_id", "query", "near", "limit").mapInArrow(run, VISITS + ", limit double")


def met(rows: DataFrame, asked: DataFrame, shelves: Shelves, meet, schema: pa.Schema, parts: int = 1) -> DataFrame:
    """What `meet` yields of each shelf and each block of the queries that visit it, in at
    least `parts` blocks if there are queries enough."""
    spark = rows.sparkSession
    m = max(blocks(asked.select("query_id", "query"), BLOCK), parts)
    where = F.broadcast(spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(shelves.first, shelves.parts, strict=True)) if p], "list int, first int, parts int"))
    group = F.col("block") * shelves.count + F.col("shelf")
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("shelf", F.explode("shelves"))
    right = rows.join(where, "list").withColumn("shelf", F.col("first") + F.pmod(F.xxhash64("chunk_id"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = left.withColumn("_group", group).drop("block", "shelf", "shelves"), right.select(*rows.columns, group.alias("_group"))
    return grouped(left, right, max(1, m * shelves.count), meet, from_arrow_schema(schema))


def guessed(index: Index, queries: DataFrame, most: int, probes: int | None) -> DataFrame:
    """query_id, chunk_id, guess: the rows whose codes are nearest, `most` a query. Codes are
    short, so as many blocks of queries as shelves let the least travel."""
    spark, dims = queries.sparkSession, index.centres.shape[-1]
    side = max(1, round(tasks(spark) ** 0.5))
    shelves = shelved(index, side)
    asked = visits(index, queries, shelves, probes or 0)
    if not probes:
        asked = asked.withColumn("shelves", F.sequence(F.lit(0), F.lit(shelves.count - 1)) if shelves.count else F.array().cast("array<int>"))
    sent = spark.sparkContext.broadcast((index.centres, index.books))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("guess", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        centres, books = sent.value
        lists, at = np.unique(b["list"].to_numpy(), return_inverse=True)
        code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(b), -1)
        x = centres[lists[at]] + books[np.arange(len(books))[None], code].reshape(len(b), -1)[:, :dims]
        x, mine = matrices.Vectors(np.arange(len(x)), x, np.ones(x.shape, bool), np.ones(len(x), bool)), b["chunk_id"].to_numpy()
        for q in matrices.by_length(a["query"]):
            near = visited(a, q.at, lists)
            allowed = (lambda some, lo, hi, near=near: near[some][:, at[lo:hi]]) if probes else None
            own = a["query_id"].to_numpy()[q.at]
            i, j, d = matrices.best(q, x, most, own, mine, allowed)
            yield pa.table({"query_id": own[i], "chunk_id": mine[j], "guess": d}, schema)

    found = met(index.codes, asked, shelves, meet, schema, min(side, max(1, queries.count() // 256)))
    return ranked(found, ["query_id"], [F.col("guess"), F.col("chunk_id")], most, "nth").drop("nth")


def visited(asked: pa.Table, at: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Which of these lists are among the nearest ones of each query."""
    out = np.zeros((len(at), len(lists)), bool)
    near = matrices.one(asked["near"]).take(pa.array(at))
    place = np.searchsorted(lists, of := near.flatten().to_numpy()).clip(max=len(lists) - 1)
    q, mine = np.repeat(np.arange(len(at)), near.value_lengths().to_numpy()), lists[place] == of
    out[q[mine], place[mine]] = True
    return out


def compared(index: Index, asked: DataFrame, shelves: Shelves, k: int, nearest: bool) -> DataFrame:
    """query_id, chunk_id, distance of the k nearest of each visited shelf, and of how many
    rows the bounds left (seen, where chunk_id is null). Of lists it takes a query's nearest ones, or
    those others that its `limit` leaves."""
    sent = asked.sparkSession.sparkContext.broadcast((index.centres, shelves))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64()), ("seen", pa.int64())])

    def meet(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        centres, shelves = sent.value
        b = b.sort_by("list")
        lists, at = np.unique(b["list"].to_numpy(), return_inverse=True)
        away, mine, limits = b["away"].to_numpy(), b["chunk_id"].to_numpy(), a["limit"].to_numpy()
        for x in matrices.by_length(b["embedding"]):
            place, out = at[x.at], away[x.at]
            for q in matrices.by_length(a["query"]):
                own, limit, near, seen = a["query_id"].to_numpy()[q.at], limits[q.at] * (1 + 1e-9), visited(a, q.at, lists), np.zeros(len(q.at), np.int64)
                low, high = between(q.x, centres[lists])
                wanted = near if nearest else ~near & ~ruled(shelves, low, high, limits[q.at], lists)

                def allowed(some, lo, hi, x=x, q=q, place=place, out=out, limit=limit, low=low, high=high, wanted=wanted, seen=seen):
                    p = place[lo:hi]
                    mask, bound = wanted[some][:, p], limit[some][:, None]
                    if mask.any() and np.isfinite(bound).any():
                        loose = bound + LOOSE * (x.norm[lo:hi][None] + q.norm[some][:, None])
                        mask &= ~(out[lo:hi][None] - high[some][:, p] > loose) & ~(low[some][:, p] - out[lo:hi][None] > loose)
                    seen[some] += mask.sum(1)
                    return mask

                i, j, d = matrices.best(q, x, k, own, mine[x.at], allowed, limit * limit)
                yield pa.table({"query_id": own[i], "chunk_id": mine[x.at][j], "distance": d, "seen": np.zeros(len(i), np.int64)}, schema)
                yield pa.table({"query_id": own, "chunk_id": pa.nulls(len(own), pa.int64()), "distance": np.full(len(own), np.inf), "seen": seen}, schema)

    return met(index.rows, asked, shelves, meet, schema)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, kept: int = 8) -> DataFrame:
    """query_id, rank, chunk_id and squared distance of the k nearest rows but the query's
    own, ties to the smaller id, by the codes of the nearest `probes` lists (by default all)
    and the vectors of kept x k rows of each query."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    found = guessed(index, queries, kept * k, probes)
    sent = F.broadcast(queries) if blocks(queries, PART) == 1 else queries
    rows = found.join(index.rows.select("chunk_id", "embedding"), "chunk_id").join(sent, "query_id")
    rows = rows.select("query_id", "chunk_id", squared_l2(F.col("query"), F.col("embedding")).alias("distance"))
    return ranked(rows, ["query_id"], [F.col("distance"), F.col("chunk_id")], k).select("query_id", "rank", "chunk_id", "distance")


def exact(index: Index, queries: DataFrame, k: int, probes: int = 8) -> tuple[DataFrame, DataFrame]:
    """As `search` without error: the nearest lists first, then what their k-th distance
    doesn't rule out; and query_id, seen: the rows compared."""
    spark = queries.sparkSession
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    shelves = shelved(index, tasks(spark))
    asked_path, path = fresh_path(spark, "index-asked"), fresh_path(spark, "index-hits")
    visits(index, queries, shelves, probes).write.parquet(asked_path)
    asked = spark.read.schema(VISITS).parquet(asked_path)
    near = compared(index, asked.withColumn("limit", F.lit(float("inf"))), shelves, k, True)
    near.write.parquet(path)
    found = spark.read.schema(near.schema).parquet(path)
    best = ranked(found.where("chunk_id IS NOT NULL"), ["query_id"], [F.col("distance"), F.col("chunk_id")], k)
    limit = best.groupBy("query_id").agg(F.when((F.count("*") == k) & ~F.isnan(F.max("distance")), F.sqrt(F.max("distance"))).alias("limit"))
    rest = asked.join(limit, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    found = found.unionByName(compared(index, others(index, rest, shelves), shelves, k, False))
    hits = ranked(found.where("chunk_id IS NOT NULL"), ["query_id"], [F.col("distance"), F.col("chunk_id")], k).select("query_id", "rank", "chunk_id", "distance")
    return hits, found.groupBy("query_id").agg(F.sum("seen").alias("seen"))
