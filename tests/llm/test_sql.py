"""Every op query that SQL can express against that SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from cohortweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()) and got
