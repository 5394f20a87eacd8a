"""Every engine query equals its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from granary.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if x is None or x is pd.NA or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return list(frame.columns), sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    (names, got), (expected_names, want) = rows(got), rows(want)
    assert names == expected_names
    strip = lambda x: [tuple(c.removesuffix(".0") if isinstance(c, str) else c for c in r) for r in x]
    assert strip(got) == strip(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
