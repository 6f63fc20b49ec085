import math
import random
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.operators import cache, chunk, infer, profile, quality, ratelimit, retrieval, usage
from millrace.plans import medallion
from millrace.sources import sinks

T0 = datetime(2025, 1, 1)


# --- profiles and quality


def metrics(df, **options):
    return {(r.column_name, r.metric): r.value for r in profile.profile(df, **options).collect()}


def test_profile_dirt(spark):
    df = spark.createDataFrame([(1, None, 1.0, "a", {"k": "v"}), (2, None, float("nan"), None, {"k": "v"}), (2, None, 4.0, "bcd", None)], "n int, void string, d double, s string, m map<string,string>")
    m = metrics(df)
    assert (m["d", "null_count"], m["d", "unique_count"], m["d", "mean"], m["d", "median"]) == (1, 2, 2.5, 2.5)
    assert (m["void", "null_rate"], m["void", "unique_count"], m["void", "min_length"]) == (1.0, 0, None)
    assert (m["s", "min_length"], m["s", "max_length"], m["s", "avg_length"]) == (1, 3, 2.0)
    assert m["n", "unique_rate"] == 2 / 3 and m["m", "unique_count"] == 1 and ("m", "min") not in m
    assert metrics(df, approximate=True)["n", "unique_count"] == 2


def test_profile_empty_and_single(spark):
    df = spark.createDataFrame([(5.0,)], "d double")
    assert metrics(df)["d", "std"] is None
    m = metrics(df.limit(0))
    assert m["d", "total_count"] == 0 and m["d", "null_rate"] == 0 and m["d", "unique_rate"] == 0 and m["d", "min"] is None


def test_profile_columns_and_types(spark):
    df = spark.createDataFrame([(1, 2, True)], "a int, b long, c boolean")
    assert {c for c, _ in metrics(df, columns="a, zz")} == {"a"}
    assert ("a", "min") not in {(r.column_name, r.metric) for r in quality.quality_profile(df).collect()}
    assert ("b", "min") in {(r.column_name, r.metric) for r in quality.quality_profile(df).collect()}


def test_top_values_ties(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "a", "b", "c", None]], "x string")
    assert [(r.value, r["count"]) for r in profile.top_values(df, "x", 2).orderBy("place").collect()] == [("a", 2), ("b", 2)]


def test_sample_and_sketch(spark):
    df = spark.range(1000)
    a = {r.id for r in profile.deterministic_sample(df, "id", 0.2).collect()}
    assert a == {r.id for r in profile.deterministic_sample(df.repartition(7), "id", 0.2).collect()} and 120 < len(a) < 280
    s = profile.sketch_of(df)
    assert s["rows"] == 1000 and len(s["sample"]) == 5


def test_score_and_anomalies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x")], "user_id long, rare string")
    long = quality.quality_profile(df)
    assert {(r.column_name, r.type) for r in quality.anomalies(long).collect()} == {("rare", "high_null_rate"), ("user_id", "low_uniqueness")}
    assert math.isclose(quality.score(long).first().score, 100 - 10 - 15 - 20 * (2 / 3) / 2)
    assert quality.score_table(df).first() == quality.score(long).first()
    assert quality.score_table(df.limit(0)).first().score == 85


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 3), st.none() | st.text(max_size=3)), max_size=8))
def test_score_stays_in_range(spark, rows):
    df = spark.createDataFrame(rows, "valid_id long, widths string")
    assert 0 <= quality.score(quality.quality_profile(df)).first().score <= 100


def test_rules(spark):
    df = spark.createDataFrame([(k, k - 5, 1.5, "x") for k in range(10)], "order_id long, delta long, price double, width string")
    got = {(r.rule, r.kind) for r in quality.rules(df).collect()}
    assert got == {("order_id_not_null", "not_null"), ("order_id_unique", "unique"), ("order_id_positive", "in_range"), ("price_positive", "in_range"), ("width_not_null", "not_null")}


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (None, None)], "v int, s string")
    checks = [quality.Expectation("nn", "v", "not_null"), quality.Expectation("pos", "v", "in_range", "low", {"min": 0}), quality.Expectation("set", "s", "in_set", "low", {"values": ["a"]})]
    assert {r.name: r.violations for r in quality.violations(df, checks).collect()} == {"nn": 1, "pos": 1, "set": 1}
    assert [r.v for r in quality.enforce(df, checks).collect()] == [1]
    assert sorted(r.failed for r in quality.flag(df, checks).collect()) == [[], ["nn"], ["pos", "set"]]
    assert checks[0].rule() == "v IS NOT NULL" and len(quality.suite_text(checks)) == 2
    with pytest.raises(ValueError):
        quality.Expectation("u", "v", "unique").holds()


def test_keys_and_references(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (3,)], "k int")
    assert {(r.k, r.rows) for r in quality.duplicates(df, ["k"]).collect()} == {(1, 2), (None, 2)}
    u = quality.table_unique(df, "k").first()
    assert (u.rows, u.distinct_values, u.is_unique) == (5, 2, False)
    assert [r.k for r in quality.orphans(df, "k", spark.createDataFrame([(1,), (None,)], "p int"), "p").collect()] == [3]


# --- chunking


def python_fixed(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = next((end - i for i in range(min(50, size)) if text[end - i] in " \n"), None)
            end = end if cut is None else cut
        if text[start:end].strip():
            out.append((text[start:end].strip(), start, end))
        start = end - overlap
    return out


def python_packed(parts, size, overlap, joint):
    out, cur, n = [], [], 0
    for p in parts:
        if n + len(p) > size and cur:
            out.append(joint.join(cur))
            kept, m = [], 0
            for s in reversed(cur):
                if not overlap or m + len(s) > overlap:
                    break
                kept.insert(0, s)
                m += len(s)
            cur, n = kept, m
        cur.append(p)
        n += len(p)
    return out + ([joint.join(cur)] if cur else [])


def texts():
    rng = random.Random(4)
    words = ["alpha", "be", "gämma.", "delta!", "x" * 30, "eps?", "\n\n", "\n", "  ", "zeta."]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(25)] + ["A" * 250, "", "   ", "one. two", "No end", "a" * 30 + " " + "b" * 300]


def test_chunkers_against_plain_python(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, t string")
    fixed, sent, para = {}, {}, {}
    for r in chunk.fixed_size(df, "id", "t", 100, 20).orderBy("chunk_index").collect():
        fixed.setdefault(r.document_id, []).append((r.content, r.start_char, r.end_char))
    for r in chunk.sentences(df, "id", "t", 120, 30).orderBy("chunk_index").collect():
        sent.setdefault(r.document_id, []).append(r.content)
    for r in chunk.paragraphs(df, "id", "t", 120).orderBy("chunk_index").collect():
        para.setdefault(r.document_id, []).append(r.content)
    for i, t in rows:
        assert fixed.get(i, []) == python_fixed(t, 100, 20)
        assert sent.get(i, []) == python_packed(re.split(r"(?<=[.!?])\s+", t), 120, 30, " ")
        assert para.get(i, []) == python_packed([p.strip() for p in t.split("\n\n") if p.strip()], 120, 0, "\n\n")


def test_chunk_edges(spark):
    df = spark.createDataFrame([("d", None, {"k": "v"}, "x"), ("e", "", {}, "x"), ("f", "A" * 250, None, "x")], "id string, t string, m map<string,string>, content string")
    got = chunk.chunk(df, "id", "t", "fixed_size", 100, 20, "m").collect()
    assert [(r.id, len(r.content)) for r in got] == [("f_chunk_0", 100), ("f_chunk_1", 100), ("f_chunk_2", 90), ("f_chunk_3", 10)]
    assert [(r.document_id, r.content) for r in chunk.chunk(df, "id", "t", "sentence", 100, 20).filter("document_id = 'e'").collect()] == [("e", "")]
    assert chunk.chunk(df.limit(0), "id", "t", "paragraph").count() == 0
    with pytest.raises(ValueError):
        chunk.fixed_size(df, "id", "t", 100, 60)
    with pytest.raises(ValueError):
        chunk.chunk(df, "id", "t", "other")


# --- retrieval


def test_top_k_ties_zero_and_filters(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0], "m"), ("a", [2.0, 0.0], "m"), ("z", [0.0, 0.0], "m"), ("n", None, "m"), ("c", [1.0, 0.1], "o"), ("w", [1.0], "m")], "id string, embedding array<double>, model string")
    asks = spark.createDataFrame([("q", [3.0, 0.0], "m")], "id string, embedding array<double>, model string")
    got = retrieval.top_k(asks, items, 5, 2).orderBy("place").collect()
    assert [r.item_id for r in got] == ["a", "b", "c", "z"] and got[-1].score == 0.0
    assert [r.item_id for r in retrieval.top_k(asks, items, 5, 2, threshold=1.0 - 1e-9, per="model").orderBy("place").collect()] == ["a", "b"]
    assert retrieval.top_k(asks, items, 5, 2, threshold=1.0).count() == 0
    assert retrieval.top_k(asks.limit(0), items).count() == 0 and retrieval.top_k(asks, items.limit(0), dim=2).count() == 0


def test_metadata_and_context(spark):
    df = spark.createDataFrame([("a", {"k": "1"}, "A"), ("b", {"x": "1"}, "B"), ("c", None, "C")], "id string, metadata map<string,string>, content string")
    assert [r.id for r in retrieval.metadata_filter(df, {"k": "1"}).collect()] == ["a"]
    ranked = spark.createDataFrame([("q", "c", 1), ("q", "a", 2)], "query_id string, item_id string, place int")
    got = retrieval.context(ranked, df).first()
    assert (got.context, got.total_results) == ("C\n\nA", 2)


def test_versions(spark):
    df = spark.createDataFrame([("t", "2.0", 1), ("t", "1.1", 2)], "name string, version string, added_at int")
    assert retrieval.latest_versions(df).first().version == "1.1"


# --- usage


def test_cost_and_totals(spark):
    calls = spark.createDataFrame([("m", 1000, 2000, 100.0), ("other", 10, None, float("nan")), (None, None, 5, None)], "model string, input_tokens int, output_tokens int, latency_ms double")
    prices = spark.createDataFrame([("m", 0.5, 0.25), ("m", 0.5, 0.25)], "model string, input_per_1k double, output_per_1k double")
    got = usage.totals(usage.with_cost(calls, prices)).first()
    assert got.calls == 3 and math.isclose(got.cost, 1.0 + 0.00001 + 0.00001) and got.latency_ms == 100.0
    empty = usage.totals(usage.with_cost(calls.limit(0), prices)).first()
    assert (empty.calls, empty.cost, empty.avg_latency_ms) == (0, 0.0, 0.0)
    assert math.isclose(usage.totals(usage.with_cost(calls, prices, 0, 0)).first().cost, 1.0)


def test_estimated_tokens(spark):
    df = spark.createDataFrame([("a" * 9, None, None, 7)], "prompt string, response string, input_tokens int, output_tokens int")
    r = usage.with_estimated_tokens(df).first()
    assert (r.input_tokens, r.output_tokens) == (2, 7)


def test_known_estimate(spark):
    asked = spark.createDataFrame([(1000, 100, 200, "gemini-1.5-flash")], "row_count bigint, avg_input_tokens bigint, avg_output_tokens bigint, model string")
    r = usage.cost_estimates(asked, usage.list_prices(spark)).first()
    assert (r.total_input_tokens, r.total_output_tokens) == (100_000, 200_000) and math.isclose(r.total_cost, 0.0675)


# --- limits and cache


def python_decisions(events, limits):
    kept, out = {}, {}
    for user, at, key in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        times = [t for t in kept.get(user, []) if (at - t).total_seconds() < 86_400]
        why = next((name for seconds, most, name in limits.checks() if sum((at - t).total_seconds() < seconds for t in times) >= most), None)
        kept[user] = times + ([at] if why is None else [])
        out[key] = why
    return out


@pytest.mark.parametrize("limits", [ratelimit.Limits(3, 5, 8, 2), ratelimit.Limits(1, 2, 5, 1), ratelimit.Limits(0, 1, 1, 1)])
def test_decisions_against_plain_python(spark, limits):
    rng = random.Random(2)
    events = [(f"u{rng.randrange(4)}", T0 + timedelta(seconds=rng.choice([0, 0.5, 1, 59, 60, 61, 3600, 86_400]) * rng.randrange(5)), k) for k in range(300)]
    df = spark.createDataFrame(events, "user string, ts timestamp, key int")
    assert {r.key: r.stopped_by for r in ratelimit.decisions(df, "user", "ts", "key", limits).collect()} == python_decisions(events, limits)


def test_decisions_dirt(spark):
    df = spark.createDataFrame([(None, T0, 1), (None, T0, 2), ("u", None, 3)], "user string, ts timestamp, key int")
    got = {r.key: (r.admitted, r.stopped_by) for r in ratelimit.decisions(df, "user", "ts", "key", ratelimit.Limits(1, 9, 9, 9)).collect()}
    assert got == {1: (True, None), 2: (False, "minute"), 3: (False, "no_time")}
    assert ratelimit.decisions(df.limit(0), "user", "ts", "key").count() == 0


def test_sliding_leaves_out_an_exact_minute(spark):
    df = spark.createDataFrame([("u", T0, 1), ("u", T0 + timedelta(seconds=60), 2), ("u", T0 + timedelta(seconds=119.999999), 3)], "user string, ts timestamp, key int")
    got = {r.key: r.last_60s for r in ratelimit.sliding_counts(df, "user", "ts", (60,)).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_replay(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    df = spark.createDataFrame([("k", at(0), 1), ("k", at(10), 2), ("k", at(11), 3), ("k", at(20), 4), ("j", at(5), 5), ("j", None, 6)], "key string, ts timestamp, n int")
    got = {r.n: r.hit for r in cache.replay(df, ["key"], "ts", "n", 10).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    assert {r.n for r in cache.replay(df, ["key"], "ts", "n", 0).filter("hit").collect()} == {2, 3, 4}
    assert cache.hit_rate(cache.replay(df.limit(0), ["key"], "ts", "n", 10)).first().hit_rate == 0.0


def test_lru_known_workload(spark):
    asks = ["k1", "k2", "k3", "k1", "k4", "k1", "k4", "k2"]
    df = spark.createDataFrame([("c", k, T0 + timedelta(seconds=i), i) for i, k in enumerate(asks)], "c string, key string, ts timestamp, n int")
    got = {r.n: r.hit for r in cache.lru_hits(df, "key", "ts", "n", ["c"], 3).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False}


def entries(spark):
    rows = [("e1", "k1", "r" * 8, T0, T0 + timedelta(hours=1), 0, None), ("e2", "k2", "r", T0, None, 2, T0), ("e3", "k1", "new", T0 + timedelta(minutes=1), T0 + timedelta(hours=2), 1, None)]
    return spark.createDataFrame(rows, "entry_id string, key string, response string, created_at timestamp, expires_at timestamp, hit_count int, last_accessed timestamp")


def test_cache_table_changes(spark):
    e, at = entries(spark), lambda h: F.lit(T0 + timedelta(hours=h))
    assert {r.entry_id for r in cache.live(e, at(1)).collect()} == {"e1", "e2", "e3"}
    left, gone = cache.purge(e, at(1.5))
    assert {r.entry_id for r in left.collect()} == {"e2", "e3"} and gone.first().evictions == 1
    asks = spark.createDataFrame([("k1",), ("k9",), ("k1",)], "key string")
    assert sorted(str(r.entry_id) for r in cache.lookup(e, asks, at(0)).collect()) == ["None", "e3", "e3"]
    log = spark.createDataFrame([("k2", T0 + timedelta(hours=3)), ("k2", T0)], "key string, ts timestamp")
    t = cache.touched(e, log).filter("entry_id = 'e2'").first()
    assert (t.hit_count, t.last_accessed) == (4, T0 + timedelta(hours=3))
    assert {r.entry_id for r in cache.without_keys(e, asks).collect()} == {"e2"}
    assert {r.entry_id for r in cache.upsert(e, e.filter("entry_id = 'e1'").withColumn("response", F.lit("z")), ["key"], [F.desc("created_at")]).collect()} == {"e2", "e3"}
    assert [r.entry_id for r in cache.evict_oldest(e, 1).collect()] == ["e3"]
    assert cache.savings(e).first().saved == 2 / 1000 * 0.01
    r = spark.createDataFrame([("c", 1, 10.0), ("c", 2, 20.0)], "c string, n int, latency_ms double")
    assert [x.mean_so_far for x in cache.running_latency(r, ["c"], ["n"]).orderBy("n").collect()] == [10.0, 15.0]


def test_merge_history_masks(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "n", 3)], "k int, v string, w int")
    b = spark.createDataFrame([(2, None, 9), (3, "z", 8), (None, "m", None)], "k int, v string, w int")
    assert {tuple(r) for r in sinks.merge(a, b, ["k"]).collect()} == {(1, "x", 1), (2, "y", 9), (3, "z", 8), (None, "m", 3)}
    h = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, ts int")
    assert [(r.v, r.valid_from, r.valid_to, r.is_current) for r in medallion.history(h, ["k"], "ts", ["v"]).orderBy("valid_from").collect()] == [("a", 1, 3, False), ("b", 3, None, True)]
    assert medallion.masked(a, ["v"], False).filter("k = 1").first().v == "x" and medallion.masked(a, ["v"], True) is a
    assert medallion.row_filtered(a, "v", []).count() == 0 and medallion.row_filtered(a, "v", [], admin=True).count() == 3
    s = medallion.standardised(spark.createDataFrame([("7",), ("x",)], "n string"), {"n": "int"}, {"n": 0})
    assert sorted(r.n for r in s.collect()) == [0, 7]


# --- models


def test_infer(spark):
    df = spark.createDataFrame([(1, "hi"), (2, ""), (3, None)], "id int, p string")
    assert {r.id: r.ai_response for r in infer.with_answers(df, "p", partitions=2).collect()} == {1: infer.echo_stub(["hi"])[0], 2: None, 3: None}

    def broken(prompts):
        raise RuntimeError("down")

    assert [r.ai_response for r in infer.with_answers(df.limit(1), "p", infer=broken, delay=0.0).collect()] == ["Error: down"]
    got = infer.answered_rows(df.fillna("x"), lambda f: f["p"] + "!").orderBy("id").collect()
    assert got[0].ai_response == infer.echo_stub(["hi!"])[0]
