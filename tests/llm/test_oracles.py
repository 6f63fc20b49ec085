"""Every training-data query with an SQL counterpart against it, on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.llm import registry


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]}) q")
    assert got == sorted(tuple(map(plain, r)) for r in found.fetchall())
