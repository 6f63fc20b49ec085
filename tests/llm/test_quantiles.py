import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quantiles as Q


def rank_error(values, found, fraction):
    """Distance of `found`'s rank interval from the wanted rank, as a share of all rows."""
    values = np.sort(values)
    low, high = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
    want = max(1, math.ceil(fraction * len(values)))
    return max(0, low - want, want - high) / len(values)


@pytest.mark.parametrize("kind", ["sorted", "reverse", "random", "ties", "tail"])
@pytest.mark.parametrize("n", [1, 5, 2047, 2048, 300_000])
def test_rank_error(kind, n):
    rng = np.random.default_rng(7)
    values = {"sorted": np.arange(n), "reverse": np.arange(n)[::-1], "random": rng.random(n), "ties": rng.integers(0, 5, n), "tail": rng.pareto(0.5, n)}[kind].astype(float)
    whole = Q.Sketch()
    for part in np.array_split(values, min(n, 37)):
        sketch = Q.Sketch()
        sketch.add(part)
        whole.merge(Q.Sketch.load(sketch.dump()))
    assert whole.rows() == n
    for p, x in zip((0.5, 0.9, 0.95, 0.99), whole.quantiles([0.5, 0.9, 0.95, 0.99])):
        assert rank_error(values, x, p) <= (0.0 if n < Q.SIZE else 0.01)


def test_merge_order_does_not_break_the_bound():
    rng = np.random.default_rng(3)
    values = rng.normal(size=500_000)
    sketches = []
    for part in np.array_split(values, 50):
        s = Q.Sketch()
        s.add(part)
        sketches.append(s)
    while len(sketches) > 1:
        a = sketches.pop(int(rng.integers(len(sketches))))
        sketches[int(rng.integers(len(sketches)))].merge(a)
    for p, x in zip((0.5, 0.99), sketches[0].quantiles([0.5, 0.99])):
        assert rank_error(values, x, p) <= 0.01


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.p3_percentiles(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/call_usage.parquet").dropDuplicates(["call_id"]).withColumn("day", F.to_date("ts")).toPandas()
    rows["week"] = rows.ts.dt.to_period("W-SUN").dt.start_time.dt.date
    rows["month"] = rows.ts.dt.to_period("M").dt.start_time.dt.date
    totals = dict.fromkeys(("day", "week", "month", "all"), 0)
    for r in got:
        part = rows[rows.model.isna()] if r.model is None else rows[rows.model == r.model]
        part = part if r.period == "all" else part[part[r.period] == r.start]
        totals[r.period] += r.n
        values = part[r.metric].dropna().to_numpy()
        assert len(values) == r.n
        for p in Q.PERCENTS:
            assert rank_error(values, r[f"p{p}"], p / 100) <= 0.01
    assert set(totals.values()) == {rows.latency_ms.notna().sum() + rows.cost_usd.notna().sum()}


def test_dirt(spark):
    """Nulls, NaN, null keys and ids, repeated deliveries, extra columns, an empty table."""
    df = spark.createDataFrame([(1, "m", 1.0, "x"), (1, "m", 1.0, "y"), (2, None, float("nan"), "x"), (None, "m", 3.0, "x"), (None, "m", 3.0, "x"), (3, "m", None, "x")], "call_id long, model string, latency_ms double, sketch string")
    rows = Q.distinct_calls(df, "call_id", ["model", "latency_ms"])
    out = Q.read_percentiles(Q.merge_sketches(Q.build_sketches(rows, ["model"], ["latency_ms"]), ["model"], 50), ["model"]).collect()
    assert [(r.model, r.n, r.p50, r.p99) for r in out] == [("m", 3, 3.0, 3.0)]
    empty = Q.build_sketches(df.limit(0), ["model"], ["latency_ms"])
    assert Q.read_percentiles(Q.merge_sketches(empty, ["model"], 4), ["model"]).count() == 0
