"""Queries against their SQL over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from lumenframe.llm import registry

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "labels")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    want = con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
