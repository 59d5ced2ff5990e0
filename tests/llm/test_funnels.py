"""Funnels against brute force."""

import random
from datetime import datetime, timedelta

import pytest

from folioforge.llm import funnels

DDL = "client_id long, kind string, arrived_at timestamp_ntz, cell int, t string, symbols int"
START = datetime(2024, 3, 10, 1, 50)  # clocks of some zones are put forward within the hour


def brute(rows, percent=25):
    seen = {}
    for client, kind, at in {r[:3] for r in rows if None not in r[:3]}:
        seen.setdefault(client, {}).setdefault(kind, []).append(round((at - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
    out = []
    for f in funnels.FUNNELS:
        for client, of in seen.items():
            gaps = [[] for _ in f.steps]
            for first in of.get(f.steps[0], []):
                last = first
                for k, step in enumerate(f.steps):
                    if k:
                        later = [t for t in of.get(step, []) if t > last]
                        if not later or min(later) - first > 300_000_000:
                            break
                        if any(last < t <= min(later) for x in f.excluded for t in of.get(x, [])):
                            break
                        gaps[k].append(min(later) - last)
                        last = min(later)
                    else:
                        gaps[0].append(0)
            if gaps[0]:
                n = [len(g) for g in gaps]
                times = [sorted(g)[-(-percent * len(g) // 100) - 1] if g else None for g in gaps[1:]]
                out.append([f.name, client, *n, sum(x > 0 for x in n), *times])
    return sorted((tuple([*r, sum(1 for o in out if (o[0], o[6]) == (r[0], r[6]))]) for r in out), key=str)


def made(seed, clients, rows, seconds, exact):
    rnd = random.Random(seed)
    out = []
    for _ in range(rows):
        at = START + timedelta(seconds=rnd.randrange(seconds), microseconds=0 if exact else rnd.choice([0, 1, 499_999, 999_999]))
        out.append((rnd.choice([1, 1, 1, *range(clients)]), rnd.choice(["view"] * 5 + ["click"] * 4 + ["purchase", "purchase", "signup", "error", "other", None]), at, 1, "x", 2))
    out += [(None, "view", START, None, None, None), (3, "view", None, None, None, None), *out[:20]]
    return out


@pytest.mark.parametrize(("seed", "clients", "rows", "seconds", "exact"), [(1, 6, 700, 9000, True), (2, 40, 600, 4000, False), (3, 3, 500, 400, True)])
def test_funnels_are_brute_force(spark, seed, clients, rows, seconds, exact):
    data = made(seed, clients, rows, seconds, exact)
    want = brute(data)
    assert max(r[6] for r in want) == 4
    df = spark.createDataFrame(data, DDL).repartition(3)
    for cell in (funnels.CELL, 60_000_000):
        assert sorted((tuple(r) for r in funnels.counted(df, cell=cell).collect()), key=str) == want


def test_no_zone_moves_times(spark):
    data = made(4, 5, 400, 7200, True)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = sorted((tuple(r) for r in funnels.counted(spark.createDataFrame(data, DDL)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == brute(data)


def test_window_and_exclusion_edges(spark):
    at = lambda s, us=0: START + timedelta(seconds=s, microseconds=us)
    rows = [
        (1, "view", at(0)), (1, "click", at(300)),  # at the end of the window
        (2, "view", at(0)), (2, "click", at(300, 1)),  # past it
        (3, "view", at(0)), (3, "error", at(0)), (3, "click", at(5)),  # excluded at the step's own time
        (4, "view", at(0)), (4, "error", at(5)), (4, "click", at(5)),  # excluded at the next one's
        (5, "view", at(0)), (5, "click", at(0)), (5, "click", at(7)),  # later only
        (6, "view", at(-1)), (6, "click", at(1199)), (7, "other", at(1)),
    ]
    got = {(r.funnel, r.client_id): r for r in funnels.counted(spark.createDataFrame(rows, "client_id long, kind string, arrived_at timestamp_ntz")).collect()}
    assert [got["A", c].n2 for c in range(1, 7)] == [1, 0, 1, 0, 1, 0]
    assert got["A", 5].t2 == 7_000_000 and not [k for k in got if k[1] == 7]


def test_no_events(spark):
    out = funnels.counted(spark.createDataFrame([], DDL))
    assert out.count() == 0 and out.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]


def test_times_with_a_zone_and_text_clients(spark):
    data = [(f"c{r[0]}" if r[0] is not None else None, r[1], r[2]) for r in made(6, 4, 300, 3000, False)]
    df = spark.createDataFrame(data, "client_id string, kind string, arrived_at timestamp_ntz").selectExpr("client_id", "kind", "cast(arrived_at as timestamp) arrived_at")
    assert sorted((tuple(r) for r in funnels.counted(df).collect()), key=str) == brute(data)


def test_symbols_hold_seven_kinds():
    with pytest.raises(ValueError):
        funnels.kinds_of((funnels.Funnel("X", tuple("abcdefg"), ("h",)),))
