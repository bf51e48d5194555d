"""Queries with SQL give what DuckDB gives on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from pagemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name, tmp_path):
    con = duckdb.connect(config={"temp_directory": str(tmp_path), "threads": 2})
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
