"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerloom import plans


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.12g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, duck):
    df = plans.QUERIES[name](spark, sf)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    assert df.columns
    if name not in plans.SQL:
        assert got
        return
    found = duck.execute(plans.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
