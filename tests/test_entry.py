"""The driver contract: every query runs, and those with SQL agree with it."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tickloom.plans import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
CHECKED = sorted(QUERIES)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if not isinstance(x, str) and pd.isna(x):
            return None
        return round(float(x), 6) + 0.0 if not isinstance(x, (str, bool)) else x

    return sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
