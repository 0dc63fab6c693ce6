"""Every registered core query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from cohortweave.plans import annotation, cohort, reports, scoring  # noqa: F401  register their queries
from cohortweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows) if rows else []


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = canon([tuple(r[c] for c in order) for r in df.collect()])
    at = [want.columns.index(c) for c in order]
    assert repr(got) == repr(canon([tuple(r[i] for i in at) for r in want.fetchall()]))
