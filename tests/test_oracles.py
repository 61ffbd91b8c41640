"""Every ledger query against its SQL in DuckDB, over the smallest tables."""

import numbers
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, numbers.Number | Decimal | np.number):
        return round(float(x), 6)
    return str(x)


def rows(frame):
    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registered():
    assert set(ORACLES) <= set(QUERIES) and {"monthly_flow", "transfer_assign"} <= set(QUERIES)
