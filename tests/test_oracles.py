"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievewright import plans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DIR)):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_bool_dtype(out[c]) or out[c].dtype == object:
            out[c] = out[c].map(lambda x: None if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x) else str(x))
        else:
            out[c] = out[c].astype(float).round(6)
    return sorted(map(repr, out.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    got, want = plans.queries()[name](spark, DIR).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_queries_without_sql(spark):
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        rows = plans.queries()[name](spark, DIR).collect()
        assert rows and all(any(v is not None for v in r) for r in rows), name
