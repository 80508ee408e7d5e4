"""Every query of the core with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from weftline.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return tuple(sorted(v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equal(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    result = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
