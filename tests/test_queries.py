"""Every core query against its DuckDB counterpart, and plans that must hold."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        found = duck.sql(registry.ORACLES[name])
        assert got == normal(found.columns, found.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_reads_only_what_it_needs(spark, sf):
    from millrace.operators.profile import profile

    text = plain(plan(profile(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_tax, l_returnflag, nonsense")))
    assert "l_comment" not in text and "l_shipdate" not in text.split("ReadSchema")[1].split(">")[0]


def test_filters_reach_the_scan(spark, sf):
    text = plan(registry.QUERIES["sql_join_inner"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


def test_no_python_in_jvm_operators(spark, sf):
    for name in ("profile_orders", "pii_counts_by_lang", "pii_redacted_hash", "chunk_fixed", "chunk_sentences", "hash_embedding", "usage_cumulative", "sliding_usage"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert "Python" not in text and "Arrow" not in text, name
