"""Each query with SQL gives what DuckDB gives on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")])
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda data: sorted(([tuple(map(plain, r)) for r in data]), key=repr)
    assert rows(df.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
