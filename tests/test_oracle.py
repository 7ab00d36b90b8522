"""Every query of the engine with SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyrail.plans import own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def cell(v):
        if pd.isna(v):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_query(spark, duck, name):
    got, want = own.QUERIES[name](spark, SF).toPandas(), duck.sql(own.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
