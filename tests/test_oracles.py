"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import pytest

from folioforge import plans

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_is_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.ORACLE) <= set(entry.oracle_sql()) and set(plans.QUERIES) <= set(entry.queries())
