"""Named queries of the core and, for each that SQL can express, its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import guard, text, vectors
from millrace.operators import cache, chunk, infer, profile, quality, ratelimit, retrieval, usage
from millrace.plans import catalogue, medallion
from millrace.plans import oracle_parts as O
from millrace.session import as_instant, load
from millrace.sources import gateway, sinks
from millrace.streaming import pipelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, digits: int, *names: str):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), digits))
    return df


def rounded_profile(df, *names: str):
    """Rates to 8 digits, other figures to 4."""
    for n in names or ("value",):
        df = df.withColumn(n, F.when(F.col("metric").endswith("rate"), F.round(n, 8)).otherwise(F.round(n, 4)))
    return df


# --- profiles and quality -------------------------------------------------------------


def _profile(table: str):
    def run(spark, sf):
        return rounded_profile(profile.profile(load(spark, sf, table)))

    return run


for _table in ("orders", "lineitem", "customer", "call_usage", "documents"):
    QUERIES[f"profile_{_table}"] = _profile(_table)
    ORACLES[f"profile_{_table}"] = O.profile_sql(_table)


@query("SELECT column_name, metric, value FROM (" + O.profile_sql("part", "ld") + ") q")
def dq_profile_part(spark, sf):
    return rounded_profile(quality.quality_profile(load(spark, sf, "part")))


@query("SELECT p_brand AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS BIGINT) AS place FROM part GROUP BY 1 QUALIFY place <= 5")
def top_values_part(spark, sf):
    return profile.top_values(load(spark, sf, "part"), "p_brand").withColumn("place", F.col("place").cast("bigint"))


@query(O.rules_sql("events"))
def dq_rules_events(spark, sf):
    return quality.rules(load(spark, sf, "events"))


@query(O.rules_sql("call_usage"))
def dq_rules_call_usage(spark, sf):
    return quality.rules(load(spark, sf, "call_usage"))


@query(O.anomalies_sql("call_usage"))
def dq_anomalies_call_usage(spark, sf):
    return rounded(quality.anomalies(quality.quality_profile(load(spark, sf, "call_usage"))), 6, "value")


@query("WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value END AS paid, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events) SELECT 'paid' AS column_name, 'high_null_rate' AS type, round(avg(CASE WHEN paid IS NULL THEN 1.0 ELSE 0.0 END), 6) AS value FROM e HAVING value > 0.5 UNION ALL SELECT 'kind', 'high_null_rate', round(avg(CASE WHEN kind IS NULL THEN 1.0 ELSE 0.0 END), 6) AS value FROM e HAVING avg(CASE WHEN kind IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 UNION ALL SELECT 'user_id', 'low_uniqueness', round(count(DISTINCT user_id) / count(*), 6) FROM e HAVING count(DISTINCT user_id) / count(*) < 0.9 UNION ALL SELECT 'paid', 'low_uniqueness', round(count(DISTINCT paid) / count(*), 6) FROM e HAVING count(DISTINCT paid) / count(*) < 0.9")
def dq_anomalies_events(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return rounded(quality.anomalies(quality.quality_profile(e)), 6, "value")


@query(O.score_sql(list(O.TABLES)))
def dq_score_all(spark, sf):
    out = None
    for table in O.TABLES:
        one = quality.score_table(load(spark, sf, table)).select(F.lit(table).alias("table_name"), F.round("score", 4).alias("score"), F.col("columns").cast("bigint"), F.col("anomalies").cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'latency_ms' AS column_name, count(*) FILTER (latency_ms IS NULL OR isnan(latency_ms)) AS nulls, count(*) FILTER (latency_ms < 0) AS negatives FROM call_usage UNION ALL SELECT 'cost_usd', count(*) FILTER (cost_usd IS NULL OR isnan(cost_usd)), count(*) FILTER (cost_usd < 0) FROM call_usage")
def dq_null_and_negative_counts(spark, sf):
    return quality.null_and_negative_counts(load(spark, sf, "call_usage"), ["latency_ms", "cost_usd"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicate_keys(spark, sf):
    return quality.duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT id, document_id FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM rag_documents WHERE id IS NOT NULL)")
def dq_referential_chunks(spark, sf):
    return quality.orphans(load(spark, sf, "chunks"), "document_id", load(spark, sf, "rag_documents"), "id").select("id", "document_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def dq_referential_orders(spark, sf):
    parents = load(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    return quality.orphans(load(spark, sf, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("SELECT count(*) AS rows, count(DISTINCT text) AS distinct_values, count(*) = count(DISTINCT text) AS is_unique FROM documents")
def dq_unique_table_level(spark, sf):
    return quality.table_unique(load(spark, sf, "documents"), "text")


CHECKS = [
    quality.Expectation("user_known", "user_id", "not_null", "critical"),
    quality.Expectation("latency_range", "latency_ms", "in_range", "medium", {"min": 0, "max": 60_000}),
    quality.Expectation("provider_set", "provider", "in_set", "high", {"values": ["lumen", "orbit"]}),
    quality.Expectation("user_form", "user_id", "regex", "low", {"pattern": "^u-[0-9]{6}$"}),
]


@query("SELECT 'user_known' AS name, 'not_null' AS kind, 'critical' AS severity, count(*) FILTER (user_id IS NULL) AS violations FROM call_usage UNION ALL SELECT 'latency_range', 'in_range', 'medium', count(*) FILTER (NOT (latency_ms >= 0 AND latency_ms <= 60000)) FROM call_usage UNION ALL SELECT 'provider_set', 'in_set', 'high', count(*) FILTER (provider NOT IN ('lumen', 'orbit')) FROM call_usage UNION ALL SELECT 'user_form', 'regex', 'low', count(*) FILTER (NOT regexp_matches(user_id, '^u-[0-9]{6}$')) FROM call_usage")
def dq_violations(spark, sf):
    return quality.violations(load(spark, sf, "call_usage"), CHECKS)


@query("SELECT call_id, list_aggregate(list_filter([CASE WHEN user_id IS NULL THEN 'user_known' END, CASE WHEN NOT (latency_ms >= 0 AND latency_ms <= 60000) THEN 'latency_range' END, CASE WHEN provider NOT IN ('lumen', 'orbit') THEN 'provider_set' END, CASE WHEN NOT regexp_matches(user_id, '^u-[0-9]{6}$') THEN 'user_form' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS failed FROM call_usage WHERE user_id IS NULL OR NOT (latency_ms >= 0 AND latency_ms <= 60000) OR provider NOT IN ('lumen', 'orbit') OR NOT regexp_matches(user_id, '^u-[0-9]{6}$')")
def dq_flagged_rows(spark, sf):
    return quality.flag(load(spark, sf, "call_usage"), CHECKS).select("call_id", F.array_join("failed", ",").alias("failed")).filter("failed <> ''")


@query("SELECT coalesce(a.column_name, b.column_name) AS column_name, a.t AS type_a, b.t AS type_b, CASE WHEN a.t IS NULL THEN 'only_b' WHEN b.t IS NULL THEN 'only_a' WHEN a.t = b.t THEN 'same' ELSE 'retyped' END AS status FROM (VALUES ('model', 'string'), ('provider', 'string'), ('input_per_1k', 'double'), ('output_per_1k', 'double')) a(column_name, t) FULL JOIN (VALUES ('mix_id', 'string'), ('source', 'string'), ('weight', 'double'), ('max_repeats', 'int'), ('total_share', 'double')) b(column_name, t) ON a.column_name = b.column_name")
def compare_tables_schema(spark, sf):
    return quality.compare_schemas(load(spark, sf, "model_pricing"), load(spark, sf, "mix_targets"))


@query("SELECT 'only_a' AS side, count(*) AS rows FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' EXCEPT ALL SELECT * FROM orders)")
def compare_tables_data(spark, sf):
    orders = load(spark, sf, "orders")
    return quality.compare_rows(orders, orders.filter("o_orderstatus <> 'F'"))


@query("SELECT a.column_name, a.metric, a.value AS value_a, b.value AS value_b, round(b.value - a.value, 4) AS change FROM (" + O.profile_sql("supplier") + ") a FULL JOIN (" + O.profile_sql("supplier").replace("FROM supplier", "FROM (SELECT * FROM supplier WHERE s_acctbal > 0)") + ") b ON a.column_name = b.column_name AND a.metric = b.metric")
def compare_tables_statistics(spark, sf):
    s = load(spark, sf, "supplier")
    out = rounded_profile(quality.compare_profiles(s, s.filter("s_acctbal > 0")), "value_a", "value_b")
    return out.withColumn("change", F.round(F.col("value_b") - F.col("value_a"), 4))


# --- guardrails and text --------------------------------------------------------------


def _pii_sql(expression) -> str:
    return ", ".join(f"{expression(p)} AS {n}" for n, p, _, _ in guard.PII)


@query("SELECT lang, " + _pii_sql(lambda p: f"CAST(sum(len(regexp_extract_all(text, '{p}', 0, 'i'))) AS BIGINT)") + " FROM documents GROUP BY lang")
def pii_counts_by_lang(spark, sf):
    counts = load(spark, sf, "documents", ["lang", "text"]).select("lang", guard.pii_counts(F.col("text")).alias("c"))
    return counts.groupBy("lang").agg(*[F.sum(f"c.{n}").alias(n) for n, *_ in guard.PII])


@query("SELECT doc_id, rule, risk, substr(m, 1, 20) || '...' AS matched FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, '{r}' AS risk, unnest(regexp_extract_all(text, '{p}', 0, 'i')) AS m FROM documents" for n, p, r, _ in guard.PII) + ")")
def pii_findings(spark, sf):
    return load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.inline(guard.pii_findings(F.col("text"))))


@query("SELECT doc_id, NOT coalesce(" + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for _, p, r, _ in guard.PII if r == "critical") + ", false) AS passed FROM documents")
def pii_pass(spark, sf):
    return load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", guard.pii_pass(F.col("text")).alias("passed"))


@query("SELECT doc_id, md5(" + O.redact_sql("text", guard.PII) + ") AS redacted FROM documents WHERE text IS NOT NULL")
def pii_redacted_hash(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id", "text"]).filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(guard.pii_redact(F.col("text")).cast("binary")).alias("redacted"))


#: Statements with the outcome that follows from the rules by hand: (sql, findings, passes).
SQL_CASES = [
    ("SELECT * FROM t", 0, True), ("  select 1", 0, True), ("", 0, True), ("DROP TABLE t", 2, False), ("SELECT 1; DROP VIEW v", 1, False),
    ("TRUNCATE TABLE t", 2, False), ("DELETE FROM t WHERE id = 1", 2, False), ("UPDATE t SET a = 1 WHERE b = 2", 1, False), ("UPDATE t SET a = 1", 2, False),
    ("GRANT ALL ON t TO u", 2, False), ("REVOKE SELECT ON t FROM u", 1, False), ("INSERT INTO t VALUES (1)", 0, True), ("MERGE INTO t USING s ON 1 = 1", 0, True), ("CREATE USER u", 1, True),
    ("ALTER USER u", 2, False), ("SELECT 1 UNION SELECT 2", 1, True), ("SELECT 1 UNION ALL SELECT 2", 0, True), ("SELECT 1; -- x", 1, False), ("SELECT * FROM t WHERE a = '' OR '1'='1'", 1, False), ("SELECT * FROM t WHERE a = '' OR 1=1", 1, False),
    ("SELECT * FROM t WHERE id = 1 OR 1=1", 0, True), ("SELECT a INTO OUTFILE 'f'", 1, False), ("SELECT load_file('f')", 1, False), ("EXEC (x)", 1, False), ("xp_cmdshell 'dir'", 1, False), ("WITH q AS (SELECT 1) SELECT * FROM q", 0, True),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', CAST({} AS BIGINT), {})".format(s.replace("'", "''"), n, str(p).lower()) for s, n, p in SQL_CASES) + ") t(statement, findings, passed)")
def sql_validate_cases(spark, sf):
    cases = spark.createDataFrame([(s,) for s, _, _ in SQL_CASES], "statement string")
    found = guard.sql_findings(F.col("statement"))
    return cases.select("statement", F.size(found).cast("bigint").alias("findings"), guard.sql_pass(found).alias("passed"))


@query("SELECT DISTINCT call_id, substr(sha256(prompt), 1, 16) AS prompt_hash, CAST(length(prompt) AS BIGINT) AS prompt_length, CAST(coalesce(length(response), 0) AS BIGINT) AS response_length FROM llm_calls")
def audit_rows(spark, sf):
    calls = load(spark, sf, "llm_calls").dropDuplicates(["call_id"])
    rows = sinks.audit_rows(calls, "prompt", "response", "user_id", "ts", F.col("call_id"))
    return rows.select(F.col("metadata").alias("call_id"), "prompt_hash", "prompt_length", "response_length")


@query("SELECT doc_id, md5(text) AS document_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def doc_ids_and_token_estimates(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", text.document_id(t).alias("document_id"), text.token_estimate(t).alias("tokens"))


@query("SELECT DISTINCT entry_id, sha256(model || ':' || prompt) AS computed, sha256(model || ':[SYSTEM]be brief[/SYSTEM]' || prompt) AS with_system FROM cache_entries")
def cache_keys(spark, sf):
    e = load(spark, sf, "cache_entries", ["entry_id", "model", "prompt"]).distinct()
    return e.select("entry_id", text.cache_key(F.col("prompt"), F.col("model")).alias("computed"), text.cache_key(F.col("prompt"), F.col("model"), F.lit("be brief")).alias("with_system"))


@query("SELECT CASE WHEN error IS NULL THEN NULL WHEN lower(error) LIKE '%rate%' AND lower(error) LIKE '%limit%' THEN 'rate_limit' WHEN lower(error) LIKE '%token%' AND (lower(error) LIKE '%limit%' OR lower(error) LIKE '%exceed%') THEN 'token_limit' WHEN lower(error) LIKE '%not found%' OR lower(error) LIKE '%invalid%' THEN 'model_not_available' WHEN lower(error) LIKE '%auth%' OR lower(error) LIKE '%api key%' THEN 'authentication' ELSE 'other' END AS kind, count(*) AS n FROM llm_calls GROUP BY 1")
def error_classes(spark, sf):
    return load(spark, sf, "llm_calls", ["error"]).groupBy(text.error_class(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT call_id, md5(CASE WHEN regexp_matches(response, '```(?:\\w+)?\\n.*?```', 's') THEN trim(regexp_extract(response, '```(?:\\w+)?\\n(.*?)```', 1, 's'), ' \n\t\r') ELSE response END) AS code FROM llm_calls WHERE response LIKE '%```%'")
def code_blocks(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "response"]).filter("response LIKE '%```%'").distinct()
    return calls.select("call_id", F.md5(text.code_block(F.col("response")).cast("binary")).alias("code"))


@query("SELECT DISTINCT call_id, md5(nullif(regexp_extract(response, '\\{.*\\}', 0, 's'), '')) AS object, md5(nullif(regexp_extract(response, '\\[.*\\]', 0, 's'), '')) AS array FROM llm_calls WHERE response LIKE '%{%' OR response LIKE '%[%'")
def json_blocks(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "response"]).filter("response LIKE '%{%' OR response LIKE '%[%'").distinct()
    return calls.select("call_id", F.md5(text.json_object(F.col("response")).cast("binary")).alias("object"), F.md5(text.json_array(F.col("response")).cast("binary")).alias("array"))


@query("SELECT * FROM (VALUES (1, 'find rows', 'sql', '{\"query\": \"SELECT 1\"}'), (2, 'done', 'Final Answer', '{\"input\":\"four rows\"}'), (3, '', NULL, NULL)) t(id, thought, action, action_input)")
def react_steps(spark, sf):
    rows = [(1, 'Thought: find rows\nAction: sql\nAction Input: {"query": "SELECT 1"}\n\nObservation: 1'), (2, "Thought: done\nAction: Final Answer\nAction Input: four rows"), (3, "no blocks")]
    return spark.createDataFrame(rows, "id int, t string").select("id", text.react_step(F.col("t")).alias("s")).select("id", "s.*")


@query("SELECT * FROM (VALUES ('Add a key;Drop nulls;Use dates')) t(lines)")
def recommendations(spark, sf):
    reply = "Here is my list:\n1. Add a key\n- Drop nulls\n\n 3) Use dates\nThat is all"
    return spark.createDataFrame([(reply,)], "t string").select(F.array_join(text.recommendation_lines(F.col("t")), ";").alias("lines"))


@query("SELECT DISTINCT call_id, 'Model ' || coalesce(model, 'unknown') || ' on ' || coalesce(provider, '') || ': ' || CAST(input_tokens AS VARCHAR) || ' tokens' AS rendered FROM llm_calls")
def template_rendered(spark, sf):
    calls = load(spark, sf, "llm_calls", ["call_id", "model", "provider", "input_tokens"]).distinct()
    return calls.select("call_id", text.render("Model {model} on {provider}: {n} tokens", {"model": F.col("model"), "provider": F.col("provider"), "n": F.col("input_tokens")}, {"model": "unknown"}).alias("rendered"))


# --- chunking -------------------------------------------------------------------------

_DOCS = "d AS (SELECT DISTINCT id, content FROM rag_documents WHERE content IS NOT NULL)"
_STRIP = "regexp_replace({}, '^[\\s\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0]+$', '', 'g')"


def _rag(spark, sf):
    return load(spark, sf, "rag_documents", ["id", "content"]).distinct()


@query(
    f"WITH RECURSIVE {_DOCS}, c AS (SELECT id, content, 0 AS s, 0 AS e, -1 AS k FROM d UNION ALL SELECT id, content, CASE WHEN k < 0 THEN 0 ELSE e - 40 END, "
    "CASE WHEN (CASE WHEN k < 0 THEN 0 ELSE e - 40 END) + 400 < length(content) AND back > 0 THEN (CASE WHEN k < 0 THEN 0 ELSE e - 40 END) + 400 - (back - 1) ELSE (CASE WHEN k < 0 THEN 0 ELSE e - 40 END) + 400 END, k + 1 "
    "FROM (SELECT *, coalesce(least(nullif(instr(r, ' '), 0), nullif(instr(r, chr(10)), 0)), 0) AS back FROM (SELECT *, reverse(substr(content, (CASE WHEN k < 0 THEN 0 ELSE e - 40 END) + 400 - 48, 50)) AS r FROM c)) WHERE (CASE WHEN k < 0 THEN 0 ELSE e - 40 END) < length(content)) "
    "SELECT id AS document_id, s AS start_char, e AS end_char, md5(" + _STRIP.format("substr(content, s + 1, e - s)") + ") AS content FROM c WHERE k >= 0 AND " + _STRIP.format("substr(content, s + 1, e - s)") + " <> ''"
)
def chunk_fixed(spark, sf):
    out = chunk.chunk(_rag(spark, sf), "id", "content", "fixed_size", 400, 40)
    return out.select("document_id", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("content"))


@query(
    f"WITH RECURSIVE {_DOCS}, p AS (SELECT id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') AS ps FROM d), "
    "c AS (SELECT id, ps, 1 AS i, CAST([] AS VARCHAR[]) AS cur, 0 AS n, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL SELECT id, ps, i + 1, CASE WHEN n + length(ps[i]) > 500 AND len(cur) > 0 THEN [ps[i]] ELSE list_append(cur, ps[i]) END, "
    "CASE WHEN n + length(ps[i]) > 500 AND len(cur) > 0 THEN length(ps[i]) ELSE n + length(ps[i]) END, CASE WHEN n + length(ps[i]) > 500 AND len(cur) > 0 THEN list_append(done, array_to_string(cur, chr(10) || chr(10))) ELSE done END FROM c WHERE i <= len(ps)), "
    "f AS (SELECT id, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, chr(10) || chr(10))) ELSE done END AS o FROM c WHERE i = len(ps) + 1), "
    "u AS (SELECT id AS document_id, unnest(o) AS t, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS chunk_index FROM f) SELECT document_id, chunk_index, md5(t) AS content, document_id || '_chunk_' || CAST(chunk_index AS VARCHAR) AS id FROM u"
)
def chunk_paragraphs(spark, sf):
    out = chunk.chunk(_rag(spark, sf), "id", "content", "semantic", 500)
    return out.withColumn("content", F.md5(F.col("content").cast("binary")))


@query(
    f"WITH RECURSIVE {_DOCS}, p AS (SELECT id, string_split(regexp_replace(content, '([.!?])[\\s\\x0b\\x0c\\x85\\xa0]+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM d), "
    "c AS (SELECT id, ps, 1 AS i, CAST([] AS VARCHAR[]) AS cur, 0 AS n, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL SELECT id, ps, i + 1, CASE WHEN full_ THEN list_append(keep, ps[i]) ELSE list_append(cur, ps[i]) END, "
    "CASE WHEN full_ THEN coalesce(CAST(list_sum(list_transform(keep, lambda x: length(x))) AS INTEGER), 0) + length(ps[i]) ELSE n + length(ps[i]) END, CASE WHEN full_ THEN list_append(done, array_to_string(cur, ' ')) ELSE done END "
    "FROM (SELECT *, list_slice(cur, len(cur) + 1 - coalesce(list_max(list_filter(range(1, len(cur) + 1), lambda k: list_sum(list_transform(list_slice(cur, len(cur) + 1 - k, len(cur)), lambda x: length(x))) <= 150)), 0), len(cur)) AS keep, n + length(ps[i]) > 500 AND len(cur) > 0 AS full_ FROM c) WHERE i <= len(ps)), "
    "f AS (SELECT id, CASE WHEN len(cur) > 0 THEN list_append(done, array_to_string(cur, ' ')) ELSE done END AS o FROM c WHERE i = len(ps) + 1), "
    "u AS (SELECT id AS document_id, unnest(o) AS t, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS chunk_index FROM f) SELECT document_id, chunk_index, md5(t) AS content FROM u"
)
def chunk_sentences(spark, sf):
    out = chunk.chunk(_rag(spark, sf), "id", "content", "sentence", 500, 150)
    return out.select("document_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("content"))


# --- vectors and retrieval ------------------------------------------------------------


@query("SELECT id, CAST(k AS INTEGER) AS pos, CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) / 4294967296.0 * 2 - 1 AS value FROM (SELECT id, sha256(lower(content)) AS h, unnest(range(8)) AS k FROM (SELECT DISTINCT id, content FROM rag_documents WHERE content IS NOT NULL))")
def hash_embedding(spark, sf):
    docs = load(spark, sf, "rag_documents", ["id", "content"]).filter("content IS NOT NULL").distinct()
    return docs.select("id", F.posexplode(F.slice(vectors.hash_embedding(F.col("content")), 1, 8)).alias("pos", "value"))


_UNIT = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings"


@query(f"WITH v AS ({_UNIT}) SELECT query_id, item_id, round(score, 6) AS score, place FROM (SELECT q.id AS query_id, i.id AS item_id, list_cosine_similarity(q.e, i.e) AS score, CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.e, i.e) DESC, i.id) AS INTEGER) AS place FROM v q, v i WHERE CAST(q.id AS BIGINT) % 50 = 0) WHERE place <= 5")
def cosine_topk(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(retrieval.top_k(v.filter(F.col("id").cast("bigint") % 50 == 0), v, 5, 64), 6, "score")


@query(f"WITH v AS ({_UNIT}) SELECT q.id AS query_id, i.id AS item_id, round(list_cosine_similarity(q.e, i.e), 6) AS score FROM v q, v i WHERE CAST(q.id AS BIGINT) % 50 = 0 AND i.label = 3 AND list_cosine_similarity(q.e, i.e) > 0.35")
def retrieve_filtered(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    items = retrieval.metadata_filter(v, {"label": "3"})
    return rounded(retrieval.top_k(v.filter(F.col("id").cast("bigint") % 50 == 0), items, None, 64, 0.35), 6, "score").drop("place")


_USABLE = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"WITH e AS (SELECT DISTINCT entry_id, model, embedding FROM cache_entries WHERE {_USABLE}), n AS (SELECT * FROM e WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT query_id, item_id, score FROM (SELECT q.entry_id AS query_id, i.entry_id AS item_id, round(list_cosine_similarity(q.embedding, i.embedding), 6) AS score, row_number() OVER (PARTITION BY q.entry_id ORDER BY list_cosine_similarity(q.embedding, i.embedding) DESC, i.entry_id) AS p FROM n q JOIN n i ON q.model = i.model AND CAST(substr(q.entry_id, 4) AS BIGINT) % 50 = 0 AND list_cosine_similarity(q.embedding, i.embedding) > 0.85) WHERE p = 1")
def semantic_match(spark, sf):
    e = load(spark, sf, "cache_entries", ["entry_id", "model", "embedding"]).withColumnRenamed("entry_id", "id").dropDuplicates(["id"])
    asked = F.substring("id", 4, 20).cast("bigint") % 50 == 0
    return rounded(retrieval.semantic_match(e.filter(asked), e, 0.85), 6, "score")


@query(f"WITH c AS (SELECT DISTINCT ON (id) id, content, embedding FROM chunks WHERE {_USABLE}), n AS (SELECT * FROM c WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0), r AS (SELECT q.id AS query_id, i.content, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.embedding, i.embedding) DESC, i.id) AS p FROM n q, n i WHERE CAST(regexp_extract(q.id, '([0-9]+)_chunk', 1) AS BIGINT) % 50 = 0 AND list_cosine_similarity(q.embedding, i.embedding) > 0.8) SELECT query_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY p)) AS context, count(*) AS total_results FROM r WHERE p <= 3 GROUP BY 1")
def rag_context(spark, sf):
    c = load(spark, sf, "chunks", ["id", "content", "embedding"]).dropDuplicates(["id"])
    ranked = retrieval.top_k(c.filter(F.regexp_extract("id", r"(\d+)_chunk", 1).cast("bigint") % 50 == 0), c, 3, 128, 0.8)
    return retrieval.context(ranked, c).withColumn("context", F.md5(F.col("context").cast("binary")))


# --- usage, cost, tests of variants ---------------------------------------------------

_CALLS = "c AS (SELECT DISTINCT call_id, user_id, model, provider, source, input_tokens, output_tokens, latency_ms, success, ts FROM call_usage)"
_PRICED = _CALLS + ", p AS (SELECT c.*, coalesce(input_tokens, 0) / 1000.0 * coalesce(m.input_per_1k, 0.001) + coalesce(output_tokens, 0) / 1000.0 * coalesce(m.output_per_1k, 0.002) AS cost, CASE WHEN latency_ms IS NULL OR isnan(latency_ms) THEN 0 ELSE latency_ms END AS ms FROM c LEFT JOIN (SELECT DISTINCT ON (model) model, input_per_1k, output_per_1k FROM model_pricing) m USING (model))"


def _calls(spark, sf):
    return load(spark, sf, "call_usage", ["call_id", "user_id", "model", "provider", "source", "input_tokens", "output_tokens", "latency_ms", "success", "ts"]).dropDuplicates(["call_id"])


def _priced(spark, sf):
    return usage.with_cost(_calls(spark, sf), load(spark, sf, "model_pricing"))


@query(f"WITH {_PRICED} SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 9) AS cost, round(sum(ms), 6) AS latency_ms, round(sum(ms) / count(*), 7) AS avg_latency_ms FROM p GROUP BY model")
def cost_by_model(spark, sf):
    return rounded(rounded(rounded(usage.totals(_priced(spark, sf), ["model"]), 9, "cost"), 6, "latency_ms"), 7, "avg_latency_ms")


@query(f"WITH {_PRICED} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 9) AS cost, round(sum(ms), 6) AS latency_ms, round(sum(ms) / count(*), 7) AS avg_latency_ms FROM p")
def usage_summary(spark, sf):
    return rounded(rounded(rounded(usage.totals(_priced(spark, sf)), 9, "cost"), 6, "latency_ms"), 7, "avg_latency_ms")


@query(f"WITH {_PRICED} SELECT provider, grouping(provider) = 1 AS is_total, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 9) AS cost FROM p GROUP BY ROLLUP (provider)")
def usage_by_provider(spark, sf):
    return rounded(usage.by_provider(_priced(spark, sf)), 9, "cost")


@query(f"WITH {_PRICED} SELECT call_id, user_id, row_number() OVER w AS step, CAST(sum(input_tokens + output_tokens) OVER w AS BIGINT) AS tokens_so_far, round(sum(cost) OVER w, 8) AS cost_so_far FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)")
def usage_cumulative(spark, sf):
    out = usage.cumulative(_priced(spark, sf), ["user_id"], ["ts", "call_id"], F.date_trunc("week", "ts"))
    return rounded(out.select("call_id", "user_id", "step", "tokens_so_far", "cost_so_far"), 8, "cost_so_far")


@query(f"WITH {_CALLS} SELECT call_id, model, CAST(row_number() OVER (PARTITION BY model ORDER BY ts DESC, call_id) AS INTEGER) AS place FROM c QUALIFY place <= 10")
def last_calls(spark, sf):
    return usage.last_calls(_calls(spark, sf), ["model"], [F.desc("ts"), F.asc("call_id")]).select("call_id", "model", "place")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, count(*) AS responses, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 6) AS avg_latency, round(avg(CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END), 6) AS avg_score, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def ab_summary(spark, sf):
    e = load(spark, sf, "events").withColumn("variant", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    out = usage.ab_summary(e, "variant", F.col("event_type") == "error", F.col("value"), F.get_json_object("props", "$.k").cast("double"))
    return rounded(out, 6, "avg_latency", "avg_score")


@query("SELECT n AS row_count, n * 100 AS total_input_tokens, n * 200 AS total_output_tokens, round(n * 100 / 1000.0 * i, 6) AS input_cost, round(n * 200 / 1000.0 * o, 6) AS output_cost, round(n * 100 / 1000.0 * i + n * 200 / 1000.0 * o, 6) AS total_cost, m AS model FROM (VALUES (CAST(1000 AS BIGINT), 'gemini-1.5-flash', 0.000075, 0.0003), (5000, 'claude-opus-4-20250514', 0.015, 0.075), (10, 'unknown', 0.001, 0.002)) t(n, m, i, o)")
def cost_estimates(spark, sf):
    asked = spark.createDataFrame([(1000, 100, 200, "gemini-1.5-flash"), (5000, 100, 200, "claude-opus-4-20250514"), (10, 100, 200, "unknown")], "row_count bigint, avg_input_tokens bigint, avg_output_tokens bigint, model string")
    return rounded(usage.cost_estimates(asked, usage.list_prices(spark)), 6, "input_cost", "output_cost", "total_cost")


@query("SELECT user_id, count(*) FILTER (TIMESTAMP '2024-01-15 12:00:00' >= ts AND TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 1 MINUTE) AS minute, count(*) FILTER (TIMESTAMP '2024-01-15 12:00:00' >= ts AND TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 1 HOUR) AS hour, count(*) FILTER (TIMESTAMP '2024-01-15 12:00:00' >= ts AND TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 24 HOUR) AS day FROM events GROUP BY 1")
def usage_windows(spark, sf):
    return usage.usage_windows(load(spark, sf, "events"), "user_id", F.lit("2024-01-15 12:00:00").cast("timestamp"))


# --- rate limits and cache ------------------------------------------------------------


@query("SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '{n} seconds' - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS last_{n}s" for n in (1, 60, 3600, 86400)) + " FROM events")
def sliding_usage(spark, sf):
    out = ratelimit.sliding_counts(load(spark, sf, "events", ["event_id", "user_id", "ts"]), "user_id", "ts")
    return out.drop("user_id", "ts")


@query(
    "WITH RECURSIVE o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS times, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS stopped_by FROM (SELECT DISTINCT user_id FROM events) UNION ALL "
    "SELECT user_id, rn, CASE WHEN s IS NULL THEN list_append(times, us) ELSE times END, event_id, s FROM (SELECT f.user_id, o.rn, f.times, o.us, o.event_id, "
    "CASE WHEN len(list_filter(f.times, lambda t: o.us - t < 60000000)) >= 1 THEN 'minute' WHEN len(list_filter(f.times, lambda t: o.us - t < 3600000000)) >= 2 THEN 'hour' WHEN len(list_filter(f.times, lambda t: o.us - t < 86400000000)) >= 5 THEN 'day' WHEN len(list_filter(f.times, lambda t: o.us - t < 1000000)) >= 1 THEN 'burst' END AS s "
    "FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)) SELECT user_id, event_id, stopped_by IS NULL AS admitted, stopped_by FROM f WHERE event_id IS NOT NULL"
)
def rate_limit_decisions(spark, sf):
    return ratelimit.decisions(load(spark, sf, "events", ["event_id", "user_id", "ts"]), "user_id", "ts", "event_id", ratelimit.Limits(1, 2, 5, 1))


_REPLAY = (
    "WITH RECURSIVE o AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events), "
    "f AS (SELECT user_id, event_type, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS event_id, false AS hit FROM (SELECT DISTINCT user_id, event_type FROM events) UNION ALL "
    "SELECT o.user_id, o.event_type, o.rn, CASE WHEN coalesce(o.us - f.since <= 86400000000, false) THEN f.since ELSE o.us END, o.event_id, coalesce(o.us - f.since <= 86400000000, false) FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.rn = f.rn + 1), "
    "r AS (SELECT user_id, event_type, event_id, hit FROM f WHERE event_id IS NOT NULL) "
)


def _replayed(spark, sf):
    return cache.replay(load(spark, sf, "events", ["event_id", "user_id", "event_type", "ts"]), ["user_id", "event_type"], "ts", "event_id", 86_400)


@query(_REPLAY + "SELECT * FROM r")
def cache_exact_replay(spark, sf):
    return _replayed(spark, sf)


@query(_REPLAY + "SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM r")
def cache_hit_rate(spark, sf):
    return rounded(cache.hit_rate(_replayed(spark, sf)), 6, "hit_rate")


@query("WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS before FROM e) "
"SELECT b.user_id, b.event_id, b.event_type, b.before IS NOT NULL AND (SELECT count(DISTINCT o.event_type) FROM e o WHERE o.user_id = b.user_id AND o.n > b.before AND o.n < b.n) < 3 AS hit FROM b")
def cache_lru_hits(spark, sf):
    return cache.lru_hits(load(spark, sf, "events", ["event_id", "user_id", "event_type", "ts"]), "event_type", "ts", "event_id", ["user_id"], 3)


_NOW = "TIMESTAMP '2025-09-01 00:00:00'"


@query(f"SELECT DISTINCT entry_id FROM cache_entries WHERE expires_at IS NULL OR {_NOW} <= expires_at")
def cache_live(spark, sf):
    return cache.live(load(spark, sf, "cache_entries"), F.lit("2025-09-01").cast("timestamp")).select("entry_id").distinct()


@query(f"SELECT count(DISTINCT entry_id) AS evictions FROM cache_entries WHERE expires_at IS NOT NULL AND {_NOW} > expires_at")
def cache_purge(spark, sf):
    return cache.purge(load(spark, sf, "cache_entries").dropDuplicates(["entry_id"]), F.lit("2025-09-01").cast("timestamp"))[1]


@query("SELECT round(coalesce(sum(CAST(length(response) // 4 AS BIGINT) * hit_count), 0) / 1000.0 * 0.01, 6) AS saved FROM (SELECT DISTINCT entry_id, response, hit_count FROM cache_entries)")
def cache_savings(spark, sf):
    e = load(spark, sf, "cache_entries", ["entry_id", "response", "hit_count"]).distinct()
    return rounded(cache.savings(e, times=F.col("hit_count")), 6, "saved")


@query(f"WITH e AS (SELECT * FROM (SELECT DISTINCT ON (entry_id) * FROM cache_entries) WHERE expires_at IS NULL OR {_NOW} <= expires_at), u AS (SELECT key, entry_id, row_number() OVER (PARTITION BY key ORDER BY created_at DESC NULLS LAST, entry_id) AS n FROM e), q AS (SELECT DISTINCT sha256(model || ':' || prompt) AS key, call_id FROM llm_calls WHERE model IS NOT NULL UNION ALL SELECT DISTINCT key, CAST(substr(entry_id, 4) AS BIGINT) FROM cache_entries) SELECT q.call_id, u.entry_id, u.entry_id IS NOT NULL AS hit FROM q LEFT JOIN u ON q.key = u.key AND u.n = 1")
def cache_lookup(spark, sf):
    entries = load(spark, sf, "cache_entries").dropDuplicates(["entry_id"])
    calls = load(spark, sf, "llm_calls", ["call_id", "model", "prompt"]).filter("model IS NOT NULL").select(text.cache_key(F.col("prompt"), F.col("model")).alias("key"), "call_id").distinct()
    again = load(spark, sf, "cache_entries", ["key", "entry_id"]).select("key", F.substring("entry_id", 4, 20).cast("bigint").alias("call_id")).distinct()
    return cache.lookup(entries, calls.unionByName(again), F.lit("2025-09-01").cast("timestamp")).select("call_id", "entry_id", "hit")


@query("WITH e AS (SELECT DISTINCT entry_id, model, hit_count FROM cache_entries), c AS (SELECT entry_id, 'moved' AS model, 0 AS hit_count FROM e WHERE hit_count > 5 UNION ALL SELECT 'new', 'moved', 0) SELECT coalesce(c.entry_id, e.entry_id) AS entry_id, coalesce(c.model, e.model) AS model, coalesce(c.hit_count, e.hit_count) AS hit_count FROM e FULL JOIN c USING (entry_id)")
def merge_upsert(spark, sf):
    e = load(spark, sf, "cache_entries", ["entry_id", "model", "hit_count"]).distinct()
    changed = e.filter("hit_count > 5").select("entry_id", F.lit("moved").alias("model"), F.lit(0).alias("hit_count")).unionByName(spark.createDataFrame([("new", "moved", 0)], "entry_id string, model string, hit_count int"))
    return sinks.merge(e, changed, ["entry_id"])


@query("SELECT call_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, call_id DESC) AS INTEGER) AS place FROM (SELECT DISTINCT call_id, user_id, ts FROM llm_calls) QUALIFY place <= 20")
def conversation_memory(spark, sf):
    turns = load(spark, sf, "llm_calls", ["call_id", "user_id", "ts"]).distinct()
    return retrieval.recent_messages(turns, "user_id", [F.desc("ts"), F.desc("call_id")]).select("call_id", "user_id", "place")


# --- SQL gateway ----------------------------------------------------------------------

_DUCK = {
    "sql_join_inner": catalogue.STATEMENTS["sql_join_inner"].replace("TIMESTAMP_NTZ", "TIMESTAMP"),
    "sql_join_semi": "SELECT p_brand, count(*) AS n_parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) GROUP BY p_brand",
    "sql_join_anti": "SELECT c_nationkey, count(*) AS n_idle FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_nationkey",
    "sql_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1",
    "sql_json_props": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
    "sql_range_join": "SELECT b.band, count(*) AS n_orders FROM orders o JOIN (VALUES (0, 0.0, 50000.0), (1, 50000.0, 150000.0), (2, 150000.0, 1.0e9)) b(band, low, high) ON o.o_totalprice >= b.low AND o.o_totalprice < b.high GROUP BY b.band",
    "sql_recursive_dates": "SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day) d LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d.day AS DATE) GROUP BY 1",
}


def _statement(name: str):
    def run(spark, sf):
        gateway.register(spark, sf, ["customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events"])
        return gateway.query(spark, catalogue.STATEMENTS[name])

    return run


for _name in catalogue.STATEMENTS:
    QUERIES[_name] = _statement(_name)
    ORACLES[_name] = _DUCK.get(_name, catalogue.STATEMENTS[_name])


@query("SELECT e.event_id, e.user_id, c.value AS asof_value, c.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts")
def sql_asof(spark, sf):
    e = load(spark, sf, "events", ["event_id", "user_id", "event_type", "ts", "value"])
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return gateway.as_of_join(left, e.filter("event_type = 'click'"), ["user_id"], "ts", ["value", "event_id"]).drop("ts")


# --- medallion, streams as batches, models --------------------------------------------


@query("SELECT event_type, count(*) AS count, round(sum(value), 2) AS total, round(avg(value), 6) AS average FROM (SELECT DISTINCT ON (event_id) * FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND value >= 1) GROUP BY 1")
def medallion_gold(spark, sf):
    checks = [quality.Expectation("id", "event_id", "not_null"), quality.Expectation("ts", "ts", "not_null"), quality.Expectation("value", "value", "in_range", "medium", {"min": 1})]
    rows = medallion.silver(medallion.bronze(load(spark, sf, "events")), ["event_id"], checks)
    return rounded(rounded(medallion.gold(rows, ["event_type"], "value"), 2, "total"), 6, "average")


@query("WITH c AS (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), k AS (SELECT * FROM c WHERE b IS NULL OR b <> event_type) SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS is_current FROM k")
def dimension_history(spark, sf):
    return medallion.history(load(spark, sf, "events", ["user_id", "event_type", "ts"]), ["user_id"], "ts", ["event_type"])


@query("SELECT DISTINCT user_id, regexp_replace(regexp_replace(regexp_replace(user_id, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked FROM call_usage WHERE source IN ('notebook', 'agent')")
def masked_and_filtered(spark, sf):
    rows = medallion.row_filtered(load(spark, sf, "call_usage", ["user_id", "source"]), "source", ["notebook", "agent"])
    return medallion.masked(rows.withColumn("masked", F.col("user_id")), ["masked"], False).select("user_id", "masked").distinct()


def _ntz(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_hourly(spark, sf):
    return rounded(_ntz(pipelines.tumbling(load(spark, sf, "events"), "ts", "1 hour", ["event_type"]), "window_start"), 4, "total")


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def sliding_two_hours(spark, sf):
    return _ntz(pipelines.sliding(load(spark, sf, "events"), "ts", "2 hours", "1 hour", ["event_type"]), "window_start")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_30m(spark, sf):
    return _ntz(pipelines.sessions(load(spark, sf, "events"), "ts", "30 minutes", ["user_id"]), "session_start", "session_end")


@query("SELECT doc_id, CASE WHEN text <> '' THEN CAST(length(text) AS VARCHAR) || ':' || substr(sha256(text), 1, 8) END AS ai_response FROM documents")
def ai_map_stub(spark, sf):
    return infer.with_answers(load(spark, sf, "documents", ["doc_id", "text"]), "text").drop("text")


@query("SELECT * FROM (VALUES ('model', 'string', true), ('provider', 'string', true), ('input_per_1k', 'double', true), ('output_per_1k', 'double', true)) t(column_name, data_type, nullable)")
def data_dictionary(spark, sf):
    return profile.data_dictionary(load(spark, sf, "model_pricing")).drop("comment")


from millrace.plans import checked, composed  # noqa: E402, F401  (they register their queries here)
