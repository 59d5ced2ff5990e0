"""Ordered funnels with a time window and excluded kinds, by lookahead over session strings.

A client's rows of one time collapse into one symbol, the set of their kinds as bits of a
byte; its symbols in order of time are a session string. For each funnel a pattern of the
`regex` module, matched overlapped, starts at each symbol that holds the first step. Its
lookahead passes over symbols without the next step's kind and without an excluded one,
and captures the next symbol if that has the step and nothing excluded: so a capture is
the earliest later row of the kind, with no excluded row after the previous step and not
after it. Captured positions give the times, and these the window checks.

No attempt outlives its window, so sessions are cut into cells of `CELL` microseconds: a
cell's string goes on for one window past its end, and only attempts that start in the
cell count. A client of any number of rows is spread over its cells; a task holds the rows
of one client in one cell (25 minutes by default) at once, and matches them batch by batch.
Cells of a batch are one string with separators, matched in one pass.

Quantiles are exact without a group in one task: times are counted by value, summed into
bins of 2^14 microseconds (at most 18311 in five minutes), and only the bin that holds the
wanted rank is read again by value.

Defined results: rows that lack client, kind or time are no rows; rows that repeat all
three are one; kinds that no funnel names are passed over; a client without an attempt has
no row; equal times of attempts are attempts' times each, so ties need no rule; extra
columns are ignored; an empty table gives no rows. Times without a zone are taken as they
are written, whatever the session's zone.
"""

from __future__ import annotations

from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import discard, lean, materialize, tuned


class Funnel(NamedTuple):
    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...]


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)
WITHIN = 300_000_000  # microseconds from the first step
CELL = 1_200_000_000
BIN = 14  # bits of a bin's microseconds
PERCENT = 25
MATCHES = 1 << 16  # taken from a pattern at once


def microseconds(time: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.unix_micros(time)
    since = time - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def kinds_of(funnels: tuple[Funnel, ...]) -> list[str]:
    """The kinds that funnels name, in order of their bits; at most seven."""
    out = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    if len(out) > 7:
        raise ValueError("a symbol holds seven kinds")
    return out


def pattern(funnel: Funnel, kinds: list[str]) -> regex.Pattern:
    """One match for each first step; group k captures the symbol of step k + 1."""
    bit = {k: 1 << i for i, k in enumerate(kinds)}
    out = sum(bit[k] for k in set(funnel.excluded))

    def symbols(allowed) -> bytes:
        # an empty class can't be written: one that no symbol is in
        return b"[" + (b"".join(b"\\x%02x" % s for s in range(1, 1 << len(kinds)) if allowed(s)) or b"\\xff") + b"]"

    ahead = b""
    for step in reversed(funnel.steps[1:]):
        passed = symbols(lambda s, b=bit[step]: not s & (b | out))
        wanted = symbols(lambda s, b=bit[step]: s & b and not s & out)
        ahead = b"(?:" + passed + b"*+(" + wanted + b")" + ahead + b")?"
    return regex.compile(symbols(lambda s: s & bit[funnel.steps[0]]) + b"(?=" + ahead + b")")


def sessions(rows: DataFrame, kinds: list[str], within: int, cell: int) -> DataFrame:
    """client, cell and its symbols (distance from the cell's start << 8 | kinds), in order."""
    bit = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(1 << i))))
    of = F.expr(f"(t - pmod(t, {cell}L)) div {cell}L")
    spread = rows.where(F.col("client").isNotNull() & F.col("t").isNotNull() & F.col("kind").isin(kinds)).select("client", "t", bit[F.col("kind")].alias("kind"), of.alias("own"))
    reach = -(-within // cell)  # cells whose windows reach into this one
    cells = F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.col("own") - k), lambda c: F.col("t") - c * cell < cell + within)
    spread = spread.withColumn("cell", F.explode(cells)).repartition("client", "cell")
    symbols = spread.groupBy("client", "cell", "t").agg(F.bit_or("kind").alias("s"))
    symbols = symbols.select("client", "cell", (F.shiftleft(F.col("t") - F.col("cell") * cell, 8) + F.col("s")).alias("x"))
    return symbols.groupBy("client", "cell").agg(F.sort_array(F.collect_list("x")).alias("symbols"))


def attempts(events: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, within: int = WITHIN, cell: int = CELL, client: str = "client_id", kind: str = "kind", time: str = "arrived_at") -> DataFrame:
    """client, funnel (its index), attempts that reach each step (n1, n2, ...) and the times
    from the step before (d2, d3, ...), of each cell with attempts."""
    tuned(events.sparkSession)
    kinds = kinds_of(funnels)
    rows = events.select(F.col(client).alias("client"), F.col(kind).alias("kind"), microseconds(F.col(time), events.schema[time].dataType.typeName()).alias("t"))
    depth = max(len(f.steps) for f in funnels)
    strings = sessions(rows, kinds, within, cell).select("client", "symbols")

    def run(batches):
        patterns = [pattern(f, kinds) for f in funnels]
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False)
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(x)) + row  # a separator after each cell
            text, at, of = np.zeros(len(x) + len(size), np.uint8), np.zeros(len(x) + len(size), np.int64), np.zeros(len(x) + len(size), np.int64)
            text[place], at[place], of[place] = x & 255, x >> 8, row
            text = text.tobytes()
            for number, p in enumerate(patterns):
                found, steps = p.finditer(text, overlapped=True), p.groups + 1
                parts = []
                while some := [m.regs for m in islice(found, MATCHES)]:
                    spot = np.array(some, np.int64)[:, :, 0]  # -1: not captured
                    spot = spot[at[spot[:, 0]] < cell]
                    when = at[spot]
                    ok = (spot >= 0) & (when - when[:, :1] <= within)
                    parts.append((of[spot[:, 0]], np.diff(when, axis=1), np.logical_and.accumulate(ok, axis=1)))
                if not parts:
                    continue
                where, gap, ok = (np.concatenate(c) for c in zip(*parts, strict=True))
                has = np.unique(where)
                columns = [b.column(0).take(pa.array(has)), pa.array(np.full(len(has), number, np.int32))]
                columns += [pa.array(np.bincount(where[ok[:, k]], minlength=len(size))[has]) if k < steps else pa.array(np.zeros(len(has), np.int64)) for k in range(depth)]
                for k in range(1, depth):
                    n = columns[2 + k].to_numpy()
                    values = gap[ok[:, k], k - 1] if k < steps else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["client", "funnel", *(f"n{k + 1}" for k in range(depth)), *(f"d{k + 1}" for k in range(1, depth))]
    kind_of_client = strings.schema["client"].dataType.simpleString()
    schema = ", ".join([f"client {kind_of_client}, funnel int", *(f"n{k + 1} long" for k in range(depth)), *(f"d{k + 1} array<long>" for k in range(1, depth))])
    return strings.mapInArrow(lean(run), schema)


def quantiles(gaps: DataFrame, percent: int) -> DataFrame:
    """Of each group (funnel, client, step) the ceil(percent n / 100)-th smallest value.
    gaps: value and the number n of its times, distinct values in a group."""
    group = ["funnel", "client", "step"]
    total = lambda order: Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    gaps = gaps.withColumn("bin", F.shiftright("value", BIN))
    bins = gaps.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("to", F.sum("n").over(total("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    rank = F.expr(f"({percent} * all + 99) div 100")
    chosen = bins.withColumn("rank", rank).where("to >= rank and to - n < rank").select(*group, "bin", (F.col("rank") - F.col("to") + F.col("n")).alias("rank"))
    within = gaps.join(chosen, [*group, "bin"]).withColumn("to", F.sum("n").over(total("value")))
    return within.where("to >= rank and to - n < rank").select(*group, "value")


def counted(events: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, within: int = WITHIN, cell: int = CELL, percent: int = PERCENT, client: str = "client_id", kind: str = "kind", time: str = "arrived_at") -> DataFrame:
    """funnel, client, n1.. (attempts that reach each step), deepest, t2.. (quantile of the
    microseconds from the step before) and same_depth of each funnel and client with attempts."""
    depth = max(len(f.steps) for f in funnels)
    steps = range(1, depth + 1)
    found = materialize(attempts(events, funnels, within, cell, client, kind, time), "funnel-attempts")
    deepest = F.coalesce(*(F.when(F.col(f"n{k}") > 0, k) for k in reversed(steps)))
    counts = found.groupBy("funnel", "client").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in steps)).withColumn("deepest", deepest)
    counts = materialize(counts, "funnel-counts")
    lists = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"d{k}").alias("d")) for k in steps[1:])))
    gaps = found.select("funnel", "client", lists.alias("x")).select("funnel", "client", "x.step", F.explode("x.d").alias("value"))
    gaps = materialize(gaps.groupBy("funnel", "client", "step", "value").agg(F.count("*").alias("n")), "funnel-gaps")
    times = quantiles(gaps, percent).groupBy("funnel", "client").agg(*(F.max(F.when(F.col("step") == k, F.col("value"))).alias(f"t{k}") for k in steps[1:]))
    same = counts.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))  # a row for each funnel and step
    named = F.element_at(F.array(*(F.lit(f.name) for f in funnels)), F.col("funnel") + 1)
    out = counts.join(times, ["funnel", "client"], "left").join(F.broadcast(same), ["funnel", "deepest"])
    out = materialize(out.select(named.alias("funnel"), F.col("client").alias(client), *(f"n{k}" for k in steps), "deepest", *(f"t{k}" for k in steps[1:]), "same_depth"), "funnels")
    discard(found, counts, gaps)
    return out
