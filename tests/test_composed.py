import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import guard
from millrace.operators import quality, rag, retrieval, tracking
from millrace.plans import agent, templates, texts
from millrace.sources import files


def test_template_checks_and_fills():
    v = templates.Variable
    t = templates.Template("t", "{a} of {b}{c}", (v("a"), v("b", "integer", False, 7), v("c", required=False)))
    assert t.filled(a="x") == "x of 7" and t.filled(a="x", b=2, c="!") == "x of 2!"
    for wrong in ({}, {"a": 1}, {"a": "x", "b": "2"}, {"a": "x", "b": True}):
        with pytest.raises(ValueError):
            t.filled(**wrong)
    shown = templates.Template("s", "{q}", (v("q"),), (templates.Example({"q": 1}, "one"), templates.Example({"q": 2}, "two", "next")))
    assert shown.filled(q="three") == "Here are some examples:\n\nExample 1:\n  q: 1\n  Output: one\n\nExample 2:\n  q: 2\n  Output: two\n  Explanation: next\n\n\nthree"
    assert templates.example_block([]) == "" and t.exported()["variables"][1]["default"] == 7


def test_template_library(spark):
    one, two = templates.Template("n", "old {x}", (templates.Variable("x"),), version="2"), templates.Template("n", "new {x}", (templates.Variable("x"),), version="1", tags=("sql",))
    lib = templates.Library()
    lib.add(one)
    lib.add(two)
    assert lib.get("n") is two and lib.get("n", "2") is one and lib.get("m") is None and lib.versions("n") == ["2", "1"]
    assert lib.filled("n", x=1 and "y") == "new y" and lib.names("sql") == ["n"] and lib.names("none") == [] and list(lib.exported()) == ["n"]
    assert [r.name for r in lib.search(spark, "NEW").collect()] == ["n"] and lib.search(spark, "old").count() == 0
    with pytest.raises(KeyError):
        lib.filled("m")
    assert lib.remove("n") and not lib.remove("n") and lib.table(spark).count() == 0


def test_texts_from_schemas():
    schema = T.StructType([T.StructField("id", T.LongType(), False, {"comment": "it's the key"}), T.StructField("v", T.StringType())])
    assert texts.ddl("a.b", schema, "c") == "CREATE TABLE a.b (\n  `id` BIGINT NOT NULL COMMENT 'it\\'s the key',\n  `v` STRING\n)\nCOMMENT 'c'"
    E = quality.Expectation
    entry = texts.model_entry("m", "a model", [E("x", "id", "unique"), E("y", "id", "not_null"), E("z", "v", "in_set", parameters={"values": ["a", "b"]}), E("r", "v", "referential", parameters={"table": "p", "key": "k"}), E("w", "v", "regex")])
    text = texts.schema_yaml([entry, texts.model_entry("n", "yes")], [texts.source_definition("db", "s", ["t1", "t2"])])
    assert text == (
        "version: 2\nmodels:\n  - name: m\n    description: a model\n    columns:\n      - name: id\n        tests:\n          - unique\n          - not_null\n      - name: v\n        tests:\n"
        "          - accepted_values:\n              values:\n                - a\n                - b\n          - relationships:\n              to: 'ref(''p'')'\n              field: k\n"
        "  - name: n\n    description: 'yes'\nsources:\n  - name: db_s\n    database: db\n    schema: s\n    tables:\n      - name: t1\n      - name: t2\n"
    )
    assert texts.docstring("Does it.") == '"""Does it."""'
    assert texts.docstring("Does it.", [("a", "int", "first")], "a sum", ["ValueError: never"]) == '"""Does it.\n\nArgs:\n    a (int): first\n\nReturns:\n    a sum\n\nRaises:\n    ValueError: never\n"""'
    assert "a : int\n    first" in texts.docstring("Does it.", [("a", "int", "first")], style="numpy")
    assert texts.markdown("T", "b", [("U", "c")]) == "# T\n\nb\n\n## U\n\nc\n\n" and "| id | bigint | it's the key |" in texts.table_markdown("t", schema)
    assert texts.model_sql("m", "d", " SELECT 1 ", {"materialized": "table"}) == "-- m\n-- d\n\n{{ config(materialized='table') }}\n\nSELECT 1\n"


def test_tracker(spark, tmp_path):
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_1k double, output_per_1k double")
    tracker = tracking.Tracker(spark, prices, str(tmp_path))
    with tracker:
        first = tracker.run_id
        ask = tracker.tracked("m")(lambda p: p * 2 if p else 1 / 0)
        assert ask("abcd" * 1000) == "abcd" * 2000
        with pytest.raises(ZeroDivisionError):
            ask("")
        tracker.add("x" * 20_000, None, input_tokens=5)
        rows = tracker.log().orderBy("step").collect()
        assert [(r.step, r.input_tokens, r.output_tokens, r.success) for r in rows] == [(1, 1000, 2000, True), (2, 0, 0, False), (3, 5, 0, True)]
        assert abs(rows[0].cost - 5.0) < 1e-9 and rows[2].prompt.endswith("... [truncated]") and "zero" in rows[1].error
        total = tracker.summary().first()
        assert (total.calls, total.input_tokens) == (3, 1005) and abs(total.avg_cost - total.cost / 3) < 1e-12
    with tracker:
        assert tracker.run_id != first and tracker.rows == []
    assert spark.read.json(f"{tmp_path}/calls").count() == 3 and spark.read.json(f"{tmp_path}/runs").count() == 1


def test_catalog_search_and_contexts(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS trips_demo (id BIGINT COMMENT 'first', v STRING) USING parquet COMMENT 'Late vans'")
    try:
        assert [r.table_name for r in files.search_tables(spark, "late VANS").collect()] == ["trips_demo"]
        assert [r.table_name for r in files.search_tables(spark, "rips_d", schema="default").collect()] == ["trips_demo"]
        assert "trips_demo" in [r.table_name for r in files.search_tables(spark, "trips", catalog="spark_catalog").collect()]
        assert files.search_tables(spark, "no such table").count() == 0
        assert files.table_context(spark, "trips_demo") == "Table: trips_demo\nComment: Late vans\n- id: bigint (first)\n- v: string"
        assert {r.table_name: r.columns for r in files.schema_context(spark, "default").collect()}["trips_demo"] == "id: bigint, v: string"
    finally:
        spark.sql("DROP TABLE trips_demo")


def test_reply_blocks():
    s = agent.parse('Thought: first\nsecond\nAction: run\nAction Input: {"a": [1,\n2]}\n\nObservation: x')
    assert (s.thought, s.action, s.action_input) == ("first\nsecond", "run", {"a": [1, 2]})
    s = agent.parse("Action: stop\nAction Input: plain words")
    assert (s.thought, s.action, s.action_input) == ("", "stop", {"input": "plain words"})
    s = agent.parse("nothing here")
    assert (s.thought, s.action, s.action_input) == ("", None, None)


def test_violation_rows(spark):
    own = ("word", r"\bw\w+", "low", "[W]")
    r = spark.createDataFrame([("w" * 30 + " me@x.org",)], "t string").select(guard.violation_rows(guard.pii_findings(F.col("t"), [own, *guard.PII]), 10).alias("v"), guard.pii_redact(F.col("t"), [own]).alias("r")).first()
    assert [(x.rule, x.matched) for x in r.v] == [("word", "w" * 10), ("email", "me@x.org..")] and r.r == "[W] me@x.org"


def test_store_and_answers(spark):
    schema = "id string, content string, embedding array<double>, metadata map<string,string>"
    store = spark.createDataFrame([("a", "old", [1.0] * 128, {"k": "1"}), ("b", "Red van", None, {"k": "2"})], schema)
    new = spark.createDataFrame([("a", "new", None, None), (None, "lost", None, None)], schema)
    after = {r.id: r for r in rag.add(rag.embedded(store), new).collect()}
    assert set(after) == {"a", "b"} and after["a"].content == "new" and len(after["a"].embedding) == 128 and after["b"].embedding is not None
    questions = spark.createDataFrame([("q", "red VAN"), ("r", None)], "id string, question string")
    found = {r.id: r for r in rag.answers(rag.embedded(store), questions, 1).collect()}
    assert found["q"].total_results == 1 and "Red van" in found["q"].prompt and found["q"].answer.startswith(str(len(found["q"].prompt)))
    assert found["r"].total_results == 0 and found["r"].prompt.endswith("Question: ")
    assert rag.retrieve(rag.embedded(store), questions, wanted={"k": "1"}).select("item_id").distinct().count() == 1
    docs = spark.createDataFrame([("d", "one\n\ntwo"), (None, "three"), ("e", None)], "id string, content string")
    more, counts = rag.add_documents(rag.embedded(store), docs, "id", "content", strategy="paragraph", size=1)
    assert counts.first().asDict() == {"documents": 3, "chunks": 3} and more.count() == 5


def test_top_k_without_k_and_groups(spark):
    rows = spark.createDataFrame([(f"i{k:03d}", [1.0, k / 50], "ab"[k % 2]) for k in range(100)], "id string, embedding array<double>, model string")
    asks = spark.createDataFrame([("q", [1.0, 0.0], "a"), ("n", [1.0, 0.0], None)], "id string, embedding array<double>, model string")
    got = retrieval.top_k(asks.limit(1), rows, None, 2, 0.9)
    assert got.count() == sum(1 / (1 + (k / 50) ** 2) ** 0.5 > 0.9 for k in range(100))
    got = retrieval.top_k(asks, rows, 3, 2, per="model").orderBy("place").collect()
    assert [r.item_id for r in got] == ["i000", "i002", "i004"]
    with pytest.raises(ValueError):
        retrieval.top_k(asks, rows, None, 2)


def test_compare_rows_counts_repeats(spark):
    a = spark.createDataFrame([(1, None, {"x": 1}), (1, None, {"x": 1}), (2, float("nan"), None)], "k int, v double, m map<string,int>")
    b = spark.createDataFrame([(1, None, {"x": 1}), (2, float("nan"), None), (3, 0.0, {})], "p int, q double, r map<string,int>")
    assert {r.side: r.rows for r in quality.compare_rows(a, b).collect()} == {"only_a": 1, "only_b": 1}
    assert {r.side: r.rows for r in quality.compare_rows(a.limit(0), b.limit(0)).collect()} == {"only_a": 0, "only_b": 0}
    assert json.dumps([r.asDict() for r in quality.compare_rows(a, a).collect()]).count("0") == 2


def test_running_totals_and_as_of_in_blocks(spark):
    """Blocks change nothing: a user with a third of all rows, null users, ties, rows on the border of days."""
    import datetime as dt

    from millrace.operators import usage
    from millrace.sources import gateway

    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    rows = [(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else f"u{k % 4}", at(k * 5 // 2), k, 2 * k if k % 5 else None, k / 8) for k in range(120)]
    calls = spark.createDataFrame(rows, "id int, user string, ts timestamp, input_tokens int, output_tokens int, cost double")
    plain, blocked = (sorted(map(tuple, usage.cumulative(calls, ["user"], ["ts", "id"], b).collect()), key=str) for b in (None, F.to_date("ts")))
    assert plain == blocked and len(plain) == 120
    left = calls.filter("id % 2 = 0").select("id", "user", "ts")
    right = calls.filter("id % 2 = 1 or id % 9 = 0").select("user", "ts", "cost", "input_tokens")
    got = {r.id: r.asof_cost for r in gateway.as_of_join(left, right, ["user"], "ts", ["cost", "input_tokens"]).collect()}
    want = {}
    for i, u, t, *_ in rows[::2]:
        found = [(t2, c, k) for k, u2, t2, _, _, c in rows if (k % 2 == 1 or k % 9 == 0) and u is not None and u2 == u and t2 <= t]
        want[i] = max(found)[1] if found else None
    assert got == want


def test_profile_sizes(spark, sf, monkeypatch):
    from millrace.operators import profile

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    exact = {(r.column_name, r.metric): r.value for r in profile.profile(orders, "o_custkey").collect()}
    monkeypatch.setattr(profile, "EXACT_BYTES", 1)
    sketched = {(r.column_name, r.metric): r.value for r in profile.profile(orders, "o_custkey").collect()}
    assert exact.keys() == sketched.keys() and abs(sketched["o_custkey", "unique_count"] / exact["o_custkey", "unique_count"] - 1) < 0.1
    assert {(r.column_name, r.metric): r.value for r in profile.profile(orders, "o_custkey", approximate=False).collect()} == exact
    assert profile.profile(spark.range(3)).filter("metric = 'unique_count'").first().value == 3


def test_stores(spark, tmp_path):
    from millrace.sources import stores

    store = stores.TableStore(spark, str(tmp_path / "chunks"))
    assert store.size() == 0
    rows = spark.createDataFrame([("a", "red van", {"k": "1"}), ("b", "blue van", {"k": "2"})], "id string, content string, metadata map<string,string>")
    store.add(rows)
    store.add(spark.createDataFrame([("b", "green van", None)], "id string, content string, metadata map<string,string>"))
    questions = spark.createDataFrame([("q", "GREEN VAN")], "id string, question string")
    assert store.size() == 2 and store.search(questions, 1).first().item_id == "b" and store.search(questions, wanted={"k": "1"}).first().item_id == "a"
    store.delete(spark.createDataFrame([("b",), ("zz",)], "id string"))
    assert store.size() == 1
    store.clear()
    assert store.size() == 0 and store.search(questions).count() == 0

    from millrace.functions.text import cache_key

    backend = stores.TableCache(spark, str(tmp_path / "cache"))
    entry = spark.createDataFrame([("e1", "p", "m", "old", "2025-01-01"), ("e2", "p2", "m", "x", "2025-01-01"), ("e3", "p", "m", "new", "2025-02-01")], "entry_id string, prompt string, model string, response string, at string")
    entry = entry.select("*", cache_key(F.col("prompt"), F.col("model")).alias("key"), F.col("at").cast("timestamp").alias("created_at")).drop("at")
    backend.put(entry)
    assert {r.response for r in backend.read().collect()} == {"new", "x"}
    backend.invalidate(spark.createDataFrame([("p", "m"), ("p", "other")], "prompt string, model string"))
    assert [r.entry_id for r in backend.read().collect()] == ["e2"]
    backend.clear()
    assert backend.read().count() == 0


def test_evict_oldest_by_days(spark):
    from millrace.operators import cache

    rows = [(f"e{k:02d}", None if k % 7 == 0 else f"2025-01-{1 + k % 5:02d} 0{k % 9}:00:00", None if k == 14 else "2024-12-31 00:00:00") for k in range(30)]
    df = spark.createDataFrame(rows, "entry_id string, a string, c string").select("entry_id", F.col("a").cast("timestamp").alias("last_accessed"), F.col("c").cast("timestamp").alias("created_at"))
    order = [r.entry_id for r in df.orderBy(F.coalesce("last_accessed", "created_at").desc_nulls_last(), "entry_id").collect()]
    for keep in (0, 1, 7, 12, 29, 30, 99):
        assert {r.entry_id for r in cache.evict_oldest(df, keep).collect()} == set(order[:keep])
    assert cache.evict_oldest(df.limit(0), 3).count() == 0


def test_flow_of_declared_tables(spark, tmp_path):
    from millrace.plans.flows import Flow

    flow, E = Flow(), quality.Expectation

    @flow.table(("clean",), fail=(E("some", "n", "in_range", parameters={"min": 1}),))
    def counts(clean):
        return clean.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    @flow.table(("raw",), drop=(E("known", "kind", "not_null"),))
    def clean(raw):
        return raw.dropDuplicates(["id"])

    @flow.table()
    def raw(session):
        return session.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "id int, kind string")

    assert flow.order().index("raw") < flow.order().index("clean") < flow.order().index("counts")
    want = {("a", 1), ("b", 1)}
    assert {tuple(r) for r in flow.build(spark)["counts"].collect()} == want
    assert {tuple(r) for r in spark.read.parquet(flow.write(spark, str(tmp_path))["counts"]).collect()} == want
    broken = Flow()
    broken.table(name="t", fail=(E("low", "id", "in_range", parameters={"max": 1}),))(lambda s: s.range(3))
    with pytest.raises(Exception, match="low does not hold"):
        broken.build(spark)["t"].collect()
    broken.table(("nowhere",), "u")(lambda t: t)
    with pytest.raises(ValueError):
        broken.order()


def test_tasks_sinks_and_table_function(spark):
    from millrace.operators import chunk
    from millrace.plans import tasks
    from millrace.sources import sinks

    df = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0)], "row_id long, v string, w double")
    found = tasks.analysed(df)
    assert found["score"].first().columns == 3 and found["profile"].filter("metric = 'total_count'").first().value == 2
    plan = tasks.quality_plan(df, "t")
    assert {e.kind for e in plan["expectations"]} == {"not_null", "unique", "in_range"} and "row_id" in plan["ddl"] and plan["entry"]["columns"][0]["name"] == "row_id"
    assert set(tasks.compared(df, df)) == {"schema", "statistics", "rows"} and "rows" not in tasks.compared(df, df.select("v"))
    for t in ("made_demo", "copy_demo"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    try:
        sinks.create_as(df, "made_demo", ["v"])
        sinks.clone(spark, "made_demo", "copy_demo")
        assert spark.table("copy_demo").count() == 2 and [c.name for c in spark.catalog.listColumns("copy_demo") if c.isPartition] == ["v"]
        with pytest.raises(Exception):
            sinks.create_as(df, "made_demo")
    finally:
        for t in ("made_demo", "copy_demo"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    chunk.register_table_function(spark)
    docs = spark.createDataFrame([("d", "one\n\ntwo\n\n\n\nthree three"), ("e", None)], "id string, t string")
    docs.createOrReplaceTempView("chunk_docs")
    got = [(r.id, r.chunk_index, r.content) for r in spark.sql("SELECT id, c.* FROM chunk_docs, LATERAL paragraph_chunks(t, 8) c ORDER BY 1, 2").collect()]
    assert got == [(r.document_id, r.chunk_index, r.content) for r in chunk.paragraphs(docs, "id", "t", 8).orderBy("id").collect()]
