"""Every query with SQL agrees with DuckDB on a small scale factor."""

import os

import duckdb
import pandas as pd
import pytest

from quarryline.plans import bindings, files, more, written  # noqa: F401

SF = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_agrees_with_duckdb(spark, duck, name):
    ours, theirs = bindings.QUERIES[name](spark, SF).toPandas(), duck.sql(bindings.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(bindings.QUERIES) <= set(e.queries())
