"""Queries that run readers, sinks, catalog, cache changes, guardrails and text functions on the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import guard, text
from millrace.operators import cache, infer, profile, quality, retrieval, usage
from millrace.plans import agent, medallion, tools
from millrace.plans.registry import _REPLAY, _ntz, query, rounded
from millrace.session import ensure_checkpoint_dir, load
from millrace.sources import files, gateway, sinks, stores
from millrace.streaming import pipelines


def _folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


# --- readers and sinks ----------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def read_json_lines(spark, sf):
    folder = _folder(spark)
    load(spark, sf, "nation").write.json(folder)
    return files.read_file(spark, folder, "json").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def read_csv_header(spark, sf):
    folder = _folder(spark)
    load(spark, sf, "nation").write.option("header", True).csv(folder)
    return files.read_file(spark, folder, "csv")


@query("SELECT n_name AS value FROM nation")
def read_text_lines(spark, sf):
    folder = _folder(spark)
    load(spark, sf, "nation").select(F.concat("n_name", F.lit("  \t"))).write.text(folder)
    return files.read_file(spark, folder, "text")


@query("SELECT n_name, true AS stamped FROM nation")
def json_stream_stamped(spark, sf):
    """A stream of JSON files with the time of ingestion and the file of each row."""
    folder = _folder(spark)
    load(spark, sf, "nation").write.json(folder)
    found = pipelines.run_now(files.json_stream(spark, folder, "n_name string"))
    return found.select("n_name", (F.col("ingested_at").isNotNull() & F.contains("source_file", F.lit("json"))).alias("stamped"))


@query("SELECT n_name, true AS stamped FROM nation")
def bronze_stamped(spark, sf):
    return medallion.bronze(load(spark, sf, "nation", ["n_name"])).select("n_name", F.col("ingested_at").isNotNull().alias("stamped"))


@query("SELECT * FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation) q WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def append_then_delete(spark, sf):
    """Rows appended twice, then rewritten without some keys."""
    folder, target, nation = _folder(spark), _folder(spark), load(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    for _ in range(2):
        sinks.append(nation.select("n_nationkey", "n_name"), folder)
    sinks.delete(spark, folder, target, nation.filter("n_regionkey = 1"), "n_nationkey")
    return spark.read.parquet(target)


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def truncate_table(spark, sf):
    folder, target = _folder(spark), _folder(spark)
    sinks.append(load(spark, sf, "nation", ["n_nationkey", "n_name"]), folder)
    sinks.truncate(spark, folder, target)
    return spark.read.parquet(target)


@query("SELECT user_id, substr(sha256(prompt), 1, 16) AS prompt_hash, CAST(length(prompt) AS BIGINT) AS prompt_length, CAST(coalesce(length(response), 0) AS BIGINT) AS response_length FROM llm_calls WHERE user_id IS NOT NULL AND prompt IS NOT NULL")
def audit_log_lines(spark, sf):
    """Audit rows appended as JSON lines and read back."""
    folder = _folder(spark)
    calls = load(spark, sf, "llm_calls", ["prompt", "response", "user_id", "ts"]).filter("user_id IS NOT NULL AND prompt IS NOT NULL")
    sinks.audit_log(calls, folder, prompt="prompt", response="response", user="user_id", ts="ts")
    return files.read_json(spark, folder).select("user_id", "prompt_hash", "prompt_length", "response_length")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders")
def observed_metrics(spark, sf):
    """Metrics of a run, observed while another action passes over the rows."""
    rows, seen = sinks.with_run_metrics(load(spark, sf, "orders"), f"run-{uuid.uuid4().hex}", rows=F.count(F.lit(1)), finished=F.count_if(F.col("o_orderstatus") == "F"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["finished"])], "rows bigint, finished bigint")


@query("SELECT * FROM (VALUES (true)) t(within)")
def sample_share(spark, sf):
    """A tenth of the rows by the hash of their key, the same on every run: within five standard deviations."""
    orders = load(spark, sf, "orders", ["o_orderkey"])
    one, two = (profile.deterministic_sample(orders, "o_orderkey", 0.1) for _ in "ab")
    sizes = one.agg(F.count(F.lit(1)).alias("a")).join(two.agg(F.count(F.lit(1)).alias("b"))).join(orders.agg(F.count(F.lit(1)).alias("n")))
    return sizes.select(((F.col("a") == F.col("b")) & (F.abs(F.col("a") - 0.1 * F.col("n")) <= 5 * F.sqrt(0.09 * F.col("n")))).alias("within"))


# --- catalog, gateway -----------------------------------------------------------------


def _views(spark, sf):
    for name in ("region", "nation", "orders"):
        load(spark, sf, name).createOrReplaceTempView(f"seen_{name}")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', NULL), ('r_name', 'string', NULL)) t(col_name, data_type, comment)")
def describe_table(spark, sf):
    _views(spark, sf)
    return files.describe(spark, "seen_region")


@query("SELECT count(*) AS rows, 6 AS columns, 5 AS sample FROM orders")
def table_info(spark, sf):
    _views(spark, sf)
    info = files.table_info(spark, "seen_orders")
    return spark.createDataFrame([(info["rows"], len(info["columns"]), len(info["sample"]))], "rows bigint, columns int, sample int")


@query("SELECT * FROM (VALUES ('seen_nation', 'n_nationkey: int, n_name: string, n_regionkey: int'), ('seen_orders', 'o_orderkey: bigint, o_custkey: bigint, o_orderstatus: string, o_totalprice: double, o_orderdate: timestamp_ntz...'), ('seen_region', 'r_regionkey: int, r_name: string')) t(table_name, columns)")
def schema_context(spark, sf):
    _views(spark, sf)
    return files.schema_context(spark, spark.catalog.currentDatabase()).filter("table_name LIKE 'seen\\\\_%'")


@query("SELECT * FROM (VALUES ('seen_nation'), ('seen_region')) t(table_name)")
def search_tables(spark, sf):
    _views(spark, sf)
    return files.search_tables(spark, "EN_").union(files.search_tables(spark, "seen_region")).filter("table_name LIKE 'seen\\\\_%ion'").select("table_name").distinct()


@query("SELECT (SELECT count(*) FROM orders) AS total_rows, 7 AS rows")
def gateway_limited(spark, sf):
    """A guarded statement whose rows are limited and whose total is known."""
    _views(spark, sf)
    found = gateway.run(spark, "SELECT * FROM seen_orders", 7)
    return spark.createDataFrame([(found.total_rows, len(found.rows))], "total_rows bigint, rows int")


@query("SELECT * FROM (VALUES ('seen_orders', true), ('DROP TABLE seen_orders', false), ('', false), ('explain', true)) t(statement, ok)")
def gateway_explained(spark, sf):
    """Plans of allowed statements come without running them; others are refused."""
    _views(spark, sf)

    def fine(statement: str) -> bool:
        try:
            return "Physical Plan" in gateway.explain(spark, statement)
        except gateway.Refused:
            return False

    rows = [("seen_orders", fine("SELECT * FROM seen_orders")), ("DROP TABLE seen_orders", fine("DROP TABLE seen_orders")), ("", fine("")), ("explain", fine("EXPLAIN SELECT 1"))]
    return spark.createDataFrame(rows, "statement string, ok boolean")


# --- cache ----------------------------------------------------------------------------

_ENTRIES = "SELECT DISTINCT ON (entry_id) entry_id, key, model, created_at, hit_count, last_accessed FROM cache_entries"


def _entries(spark, sf):
    rows = load(spark, sf, "cache_entries", ["entry_id", "key", "prompt", "model", "created_at", "hit_count", "last_accessed"]).dropDuplicates(["entry_id"])
    for c in ("created_at", "last_accessed"):
        rows = rows.withColumn(c, F.col(c).cast("timestamp"))
    return rows


@query(f"SELECT entry_id FROM (SELECT *, row_number() OVER (ORDER BY coalesce(last_accessed, created_at) DESC NULLS LAST, entry_id) AS n FROM ({_ENTRIES})) WHERE n <= 200")
def cache_evict_oldest(spark, sf):
    return cache.evict_oldest(_entries(spark, sf), 200).select("entry_id")


@query(f"WITH e AS ({_ENTRIES}) SELECT model, key, CASE WHEN model = 'new' THEN 'n' ELSE 'o' END AS side FROM (SELECT DISTINCT model, key FROM e WHERE key NOT IN (SELECT key FROM e WHERE hit_count = 0) UNION ALL SELECT DISTINCT 'new', key FROM e WHERE hit_count = 0)")
def cache_upsert(spark, sf):
    """Changes replace the entries of their keys, whatever the model."""
    entries = _entries(spark, sf).select("key", "model", "hit_count")
    changes = entries.filter("hit_count = 0").select("key", F.lit("new").alias("model"), "hit_count").distinct()
    replaced = entries.join(changes.select("key").distinct(), "key", "left_anti").select("model", "key").distinct()
    merged = cache.upsert(entries, changes, ["key"], [])
    return merged.filter("model = 'new'").select("model", "key").union(replaced).withColumn("side", F.when(F.col("model") == "new", "n").otherwise("o"))


@query(f"WITH e AS ({_ENTRIES}), a AS (SELECT key, count(*) AS hits FROM e GROUP BY 1) SELECT entry_id, CAST(coalesce(hit_count, 0) + hits AS INTEGER) AS hit_count, greatest(last_accessed, TIMESTAMP '2030-01-01') = TIMESTAMP '2030-01-01' AS latest FROM e JOIN a USING (key)")
def cache_touched(spark, sf):
    """Hit counts and last access brought up to date from a log with one access per entry and key."""
    entries = _entries(spark, sf).filter("key IS NOT NULL")
    accesses = entries.select("key", F.lit("2030-01-01").cast("timestamp").alias("ts"))
    found = cache.touched(entries, accesses)
    return found.select("entry_id", "hit_count", (F.col("last_accessed") == F.lit("2030-01-01").cast("timestamp")).alias("latest"))


@query(f"WITH e AS ({_ENTRIES}) SELECT entry_id FROM e WHERE key IS NULL OR key NOT IN (SELECT key FROM e WHERE hit_count > 2 AND key IS NOT NULL)")
def cache_deleted_by_key(spark, sf):
    entries = _entries(spark, sf)
    return cache.without_keys(entries, entries.filter("hit_count > 2")).select("entry_id")


@query("SELECT count(DISTINCT entry_id) AS left_over FROM (SELECT entry_id, sha256(model || ':' || prompt) AS k FROM cache_entries) WHERE k IS NULL OR k NOT IN (SELECT sha256(model || ':' || prompt) FROM cache_entries WHERE hit_count = 0 AND prompt IS NOT NULL AND model IS NOT NULL)")
def cache_invalidated(spark, sf):
    """Entries keyed by model and prompt, without those of some requests."""
    entries = _entries(spark, sf).withColumn("key", text.cache_key(F.col("prompt"), F.col("model")))
    gone = entries.filter("hit_count = 0 AND prompt IS NOT NULL AND model IS NOT NULL").select("prompt", "model")
    return stores.invalidated(entries, gone).agg(F.count(F.lit(1)).alias("left_over"))


@query(_REPLAY + "SELECT user_id || '/' || event_type AS who, event_id, hit FROM r")
def stream_cache_replay(spark, sf):
    """The keyed cache on a stream decides as the replay of the log does."""
    events = files.parquet_stream(spark, f"{sf}/events.parquet").withColumn("who", F.concat_ws("/", "user_id", "event_type"))
    return pipelines.run_now(pipelines.cached(events.select("who", "event_id", "ts"), "who", "ts", "event_id", 86_400))


# --- usage, windows -------------------------------------------------------------------


@query("SELECT call_id, round(avg(latency_ms) OVER (PARTITION BY source ORDER BY call_id ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far FROM (SELECT DISTINCT ON (call_id) call_id, source, latency_ms FROM llm_calls WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms))")
def latency_running_mean(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "source", "latency_ms"]).filter("latency_ms IS NOT NULL AND NOT isnan(latency_ms)").dropDuplicates(["call_id"])
    return rounded(cache.running_latency(calls, ["source"], ["call_id"]).select("call_id", "mean_so_far"), 6, "mean_so_far")


@query("SELECT call_id, round(coalesce(input_tokens, 0) / 1000.0 * coalesce(input_per_1k, 0) + coalesce(output_tokens, 0) / 1000.0 * coalesce(output_per_1k, 0), 9) AS cost FROM (SELECT DISTINCT call_id, model, input_tokens, output_tokens FROM llm_calls) LEFT JOIN (SELECT DISTINCT ON (model) * FROM model_pricing) USING (model)")
def usage_cost_default_zero(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "model", "input_tokens", "output_tokens"]).distinct()
    return rounded(usage.with_cost(calls, load(spark, sf, "model_pricing"), 0.0, 0.0).select("call_id", "cost"), 9, "cost")


@query("SELECT p_brand AS name, arg_max(p_type, p_partkey) AS version FROM part GROUP BY 1")
def template_latest_versions(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("version"), F.col("p_partkey").alias("added_at"))
    return retrieval.latest_versions(parts)


# --- guardrails, texts ----------------------------------------------------------------

_CRITICAL = "coalesce(" + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for _, p, risk, _ in guard.PII if risk == "critical") + ", false)"
_ANY = "coalesce(" + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for _, p, _, _ in guard.PII) + ", false)"


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'rate_limit' WHEN {_CRITICAL} THEN 'pii' END AS stopped_by FROM documents")
def combined_check(spark, sf):
    """Rate, then personal data; the first failure ends the checks."""
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", guard.combined_check(F.col("text"), F.col("doc_id") % 10 != 0)["stopped_by"].alias("stopped_by"))


@query(f"SELECT doc_id, NOT {_ANY} AS passed FROM documents")
def response_check(spark, sf):
    return load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", guard.response_pass(F.col("text")).alias("passed"))


_SNIPPETS = [(1, "import os\nos.system('ls')"), (2, "x = 1"), (3, "open('a', 'w')"), (4, "open('a')"), (5, "__import__('subprocess')")]


@query("SELECT * FROM (VALUES (1, 1), (2, 0), (3, 1), (4, 0), (5, 2)) t(id, found)")
def snippet_check(spark, sf):
    rows = spark.createDataFrame(_SNIPPETS, "id int, code string")
    return rows.select("id", F.size(guard.snippet_findings(F.col("code"))).alias("found"))


@query("SELECT * FROM (VALUES ('a', 'main.web.a', 'a'), ('b.a', 'main.b.a', 'b_a'), ('c.b.a', 'c.b.a', 'c_b_a'), ('d.c.b.a', 'd.c.b.a', 'd_c_b_a')) t(name, full_name, suite)")
def table_names(spark, sf):
    rows = spark.createDataFrame([("a",), ("b.a",), ("c.b.a",), ("d.c.b.a",)], "name string")
    return rows.select("name", text.resolve_name(F.col("name"), "main", "web").alias("full_name"), text.suite_name(F.col("name")).alias("suite"))


@query("SELECT call_id, CASE WHEN length(response) > 100 THEN substr(response, 1, 100) || '... [truncated]' ELSE response END AS kept, '[not logged]' AS withheld FROM (SELECT DISTINCT call_id, response FROM llm_calls)")
def texts_for_the_log(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "response"]).distinct()
    return calls.select("call_id", text.truncate_for_log(F.col("response"), 100).alias("kept"), text.withhold(F.col("response"), False).alias("withheld"))


# --- models, agents, suites -----------------------------------------------------------


@query("SELECT doc_id, CAST(length(p) AS VARCHAR) || ':' || substr(sha256(p), 1, 8) AS ai_response FROM (SELECT doc_id, coalesce(lang, '?') || ' ' || doc_id AS p FROM documents)")
def answered_rows(spark, sf):
    """Prompts made of whole rows, answered in batches within the partitions."""
    docs = load(spark, sf, "documents", ["doc_id", "lang"])
    return infer.answered_rows(docs, lambda frame: frame["lang"].fillna("?") + " " + frame["doc_id"].astype(str)).drop("lang")


@query("SELECT * FROM (VALUES (0, 'count', 'execute_sql', 5), (1, 'done', 'Final Answer', NULL)) t(step, thought, action, rows)")
def agent_trace(spark, sf):
    """A scripted client that counts regions with a tool and answers."""
    _views(spark, sf)
    script = iter(['Thought: count\nAction: execute_sql\nAction Input: {"query": "SELECT * FROM seen_region"}', "Thought: done\nAction: Final Answer\nAction Input: five"])
    _, trace = agent.solve("how many regions?", agent.Client(lambda prompt: next(script)), tools.spark_tools(spark))
    rows = agent.trace_table(spark, trace)
    return rows.select("step", "thought", "action", F.try_to_number(F.regexp_extract("observation", r'"total_rows": (\d+)', 1), F.lit("999")).cast("int").alias("rows"))


@query("SELECT '- a' || chr(10) || 'k: ' || repeat('v', 100) AS summary")
def memory_summary(spark, sf):
    memory = agent.Memory(context={"k": "v" * 200}, facts=["a"])
    return spark.createDataFrame([(memory.summary(),)], "summary string")


@query("SELECT * FROM (VALUES ('expect_column_values_to_not_be_null', 'id', NULL), ('expect_column_values_to_be_between', 'v', 1)) t(type, column_name, low)")
def suite_from_reply(spark, sf):
    """Expectations parsed from a model's reply, as a suite for other tools; unknown columns are passed over."""
    reply = 'Here: [{"column": "id", "type": "NOT_NULL"}, {"column": "v", "type": "in_range", "parameters": {"min": 1}}, {"column": "none", "type": "unique"}]'
    suite = quality.suite_text(quality.parse_expectations(reply, ["id", "v"]))
    return spark.createDataFrame([(s["expectation_type"], s["kwargs"]["column"], s["kwargs"].get("min_value")) for s in suite], "type string, column_name string, low int")


@query("SELECT 'value' AS column_name, metric, round(value, 4) AS value FROM (SELECT unnest(['min', 'max']) AS metric, unnest([min(value), max(value)]) AS value FROM events)")
def profile_some_columns(spark, sf):
    """A profile of chosen columns; unknown names are passed over."""
    return rounded(profile.profile(load(spark, sf, "events"), "value, nonsense").filter("metric IN ('min', 'max')"), 4, "value")


@query("SELECT event_type, ts AS newest FROM (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM events) WHERE n <= 3")
def stream_silver(spark, sf):
    """Silver rows of a stream with checks, read as a table."""
    rows = medallion.silver(files.parquet_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], [quality.Expectation("id", "event_id", "not_null")], "ts")
    found = pipelines.run_now(rows.select("event_type", "ts"))
    place = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts")))
    return _ntz(found.withColumn("n", place).filter("n <= 3").select("event_type", F.col("ts").alias("newest")), "newest")
