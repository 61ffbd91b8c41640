"""Training-data queries against their SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = lambda found: sorted((tuple(map(str, r)) for r in found), key=str)
    got = queries.queries()[name](spark, SF).select(columns).collect()
    assert rows(got) == rows(want.select(*columns).fetchall())
