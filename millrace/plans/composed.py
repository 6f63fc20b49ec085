"""Queries of composed operators: retrieval with answers, templates, call logs, catalogs, streams run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import guard, vectors
from millrace.operators import quality, rag, tracking
from millrace.plans import templates
from millrace.plans.registry import _ntz, query, rounded
from millrace.session import load
from millrace.sources import files
from millrace.streaming import pipelines

# --- retrieval ------------------------------------------------------------------------

_WORDS = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) / 4294967296.0 * 2 - 1" for k in range(8))
_USABLE = "len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"SELECT id, md5(content) AS content, round(coalesce(list_sum(list_transform(e, lambda x: abs(x))), 0), 5) AS size FROM (SELECT id, content, coalesce(embedding, list_concat([{_WORDS}], list_transform(range(120), lambda x: 0.0))) AS e FROM (SELECT DISTINCT ON (id) id, content, embedding, sha256(lower(content)) AS h FROM chunks WHERE id IS NOT NULL)) WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
def store_embedded_if_missing(spark, sf):
    """Chunks with the embedding they have, or else that of their content."""
    store = rag.embedded(load(spark, sf, "chunks", ["id", "content", "embedding"]).filter("id IS NOT NULL").dropDuplicates(["id"]))
    store = store.filter(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    return rounded(store.select("id", F.md5(F.col("content").cast("binary")).alias("content"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("size")), 5, "size")


_RAG_CHUNKS = "SELECT id, chunk_index, t FROM (SELECT id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS chunk_index FROM (SELECT id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\\s\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0]+$', '', 'g')), lambda x: x <> '') AS ps FROM (SELECT DISTINCT id, content FROM rag_documents)))"


@query(f"SELECT (SELECT count(DISTINCT id) FROM rag_documents) AS documents, (SELECT count(*) FROM ({_RAG_CHUNKS})) AS chunks, (SELECT count(*) FROM (SELECT id || '_chunk_' || chunk_index AS id FROM ({_RAG_CHUNKS}) UNION SELECT id FROM chunks WHERE id IS NOT NULL)) AS stored")
def rag_documents_added(spark, sf):
    """Documents, chunks and the size of the store after all rag documents were chunked by paragraph into the chunks that were there."""
    docs = load(spark, sf, "rag_documents", ["id", "content"]).distinct()
    store = load(spark, sf, "chunks", ["id", "content", "document_id", "chunk_index", "embedding"]).dropDuplicates(["id"])
    after, counts = rag.add_documents(store, docs, "id", "content", strategy="paragraph", size=1)
    return counts.join(after.agg(F.count(F.lit(1)).alias("stored")))


_QUESTIONS = [("q1", "Late map"), ("q2", "Why does the export fail?"), ("q3", "")]


@query(
    f"WITH q AS (SELECT * FROM (VALUES ('q1', 'Late map'), ('q2', 'Why does the export fail?'), ('q3', '')) t(id, question)), v AS (SELECT id, question, list_concat([{_WORDS}], list_transform(range(120), lambda x: CAST(0.0 AS DOUBLE))) AS e FROM (SELECT *, sha256(lower(question)) AS h FROM q)), "
    f"c AS (SELECT DISTINCT ON (id) id, content, embedding FROM chunks WHERE {_USABLE} AND id IS NOT NULL), r AS (SELECT v.id, v.question, c.content, row_number() OVER (PARTITION BY v.id ORDER BY coalesce(list_cosine_similarity(CAST(v.e AS DOUBLE[]), c.embedding), 0) DESC, c.id) AS p FROM v, c WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "t AS (SELECT id, question, count(*) AS total_results, string_agg(content, chr(10) || chr(10) ORDER BY p) AS c FROM r WHERE p <= 5 GROUP BY 1, 2), p AS (SELECT id, total_results, 'Use the passages below to answer.' || chr(10) || chr(10) || c || chr(10) || chr(10) || '## Database Context:' || chr(10) || chr(10) || 'orders: one row per order' || chr(10) || chr(10) || 'Question: ' || question AS p FROM t) "
    "SELECT id, total_results, CAST(length(p) AS VARCHAR) || ':' || substr(sha256(p), 1, 8) AS answer FROM p"
)
def rag_answers(spark, sf):
    """Retrieve (the default number for k = 0), assemble with the context of a named table, generate."""
    store = load(spark, sf, "chunks", ["id", "content", "embedding"]).filter("id IS NOT NULL").dropDuplicates(["id"]).filter(vectors.usable(F.col("embedding"), 128) & F.exists("embedding", lambda x: x != 0))
    questions = spark.createDataFrame(_QUESTIONS, "id string, question string")
    catalog = spark.createDataFrame([("orders", None, "orders: one row per order"), ("part", "parts", "part: one row per part")], "table_name string, comment string, context string")
    found = rag.answers(store, questions, 0, tables=rag.table_contexts(questions, catalog, ["orders"]))
    return found.select("id", "total_results", "answer")


@query("SELECT * FROM (VALUES ('a', 'orders: one row per order' || chr(10) || chr(10) || 'reorders: twice'), ('c', 'part: one row per part')) t(id, tables)")
def table_context_by_question(spark, sf):
    """Tables whose name or comment holds the whole question."""
    catalog = spark.createDataFrame([("orders", None, "orders: one row per order"), ("part", "all parts", "part: one row per part"), ("reorders", "", "reorders: twice")], "table_name string, comment string, context string")
    questions = spark.createDataFrame([("a", "orders"), ("b", "where are my orders?"), ("c", "all parts"), ("d", ""), ("e", None)], "id string, question string")
    return rag.table_contexts(questions, catalog)


# --- templates ------------------------------------------------------------------------

_CALL = templates.Template(
    "call_card", "Model {model} read {n} tokens for {user}.", (templates.Variable("model"), templates.Variable("n", "integer"), templates.Variable("user", required=False)),
    (templates.Example({"model": "m1", "n": 3}, "short", "few tokens"),), "1.1.0", ("usage",), "One call in words",
)
_BLOCK = "'Here are some examples:' || chr(10) || chr(10) || 'Example 1:' || chr(10) || '  model: m1' || chr(10) || '  n: 3' || chr(10) || '  Output: short' || chr(10) || '  Explanation: few tokens' || chr(10)"


@query(f"SELECT DISTINCT call_id, md5({_BLOCK} || chr(10) || chr(10) || 'Model ' || model || ' read ' || input_tokens || ' tokens for ' || coalesce(user_id, '') || '.') AS prompt FROM llm_calls")
def template_with_examples(spark, sf):
    """Prompts with a block of examples; null where a required variable is."""
    calls = load(spark, sf, "llm_calls", ["call_id", "model", "input_tokens", "user_id"]).distinct()
    prompt = _CALL.column({"model": F.col("model"), "n": F.col("input_tokens"), "user": F.col("user_id")})
    return calls.select("call_id", F.md5(prompt.cast("binary")).alias("prompt"))


@query("SELECT * FROM (VALUES ('call_card', '1.1.0', 0, false), ('call_card', '1.0.0', 1, true), ('other', '1.0.0', 0, true)) t(name, version, added, current)")
def template_versions(spark, sf):
    """The version added last is the current one, not the highest."""
    library = templates.Library()
    for template in (_CALL, templates.Template("call_card", "older"), templates.Template("other", "{x}", (templates.Variable("x"),))):
        library.add(template)
    return library.table(spark).drop("tags", "variables")


# --- call logs ------------------------------------------------------------------------

_LOG = (
    "c AS (SELECT DISTINCT call_id, source, model, ts, input_tokens, output_tokens, latency_ms, success, error, prompt, response FROM llm_calls WHERE source IS NOT NULL), "
    "l AS (SELECT source AS run_id, row_number() OVER (PARTITION BY source ORDER BY ts, call_id) AS step, call_id, coalesce(CAST(input_tokens AS BIGINT), length(prompt) // 4, 0) AS i, coalesce(CAST(output_tokens AS BIGINT), length(response) // 4, 0) AS o, coalesce(latency_ms, 0) AS ms, m.input_per_1k, m.output_per_1k, c.prompt FROM c LEFT JOIN (SELECT DISTINCT ON (model) model, input_per_1k, output_per_1k FROM model_pricing) m USING (model)), "
    "k AS (SELECT *, i / 1000.0 * coalesce(input_per_1k, 0.001) + o / 1000.0 * coalesce(output_per_1k, 0.002) AS cost FROM l)"
)


def _log(spark, sf):
    columns = ["call_id", "source", "model", "provider", "ts", "input_tokens", "output_tokens", "latency_ms", "success", "error", "prompt", "response"]
    calls = load(spark, sf, "llm_calls", columns).filter("source IS NOT NULL").dropDuplicates(["call_id"])
    return tracking.call_log(calls, load(spark, sf, "model_pricing"), "source", ["ts", "call_id"], keep_responses=False)


@query(f"WITH {_LOG} SELECT run_id, step, i AS input_tokens, o AS output_tokens, round(cost, 8) AS cost, md5(CASE WHEN length(prompt) > 10000 THEN substr(prompt, 1, 10000) || '... [truncated]' ELSE prompt END) AS prompt, '[not logged]' AS response FROM k")
def call_log(spark, sf):
    """A row per call: step in its run, tokens, cost, texts cut to 10,000 characters or withheld."""
    rows = _log(spark, sf).select("run_id", "step", "input_tokens", "output_tokens", "cost", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "response")
    return rounded(rows, 8, "cost")


@query(f"WITH {_LOG} SELECT run_id, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(cost), 6) AS cost, round(sum(CASE WHEN isnan(ms) THEN 0 ELSE ms END) / count(*), 4) AS avg_latency_ms, round(sum(cost) / count(*), 8) AS avg_cost FROM k GROUP BY 1")
def call_log_summary(spark, sf):
    """Figures of each run."""
    return rounded(rounded(rounded(tracking.run_summary(_log(spark, sf)), 6, "cost"), 4, "avg_latency_ms"), 8, "avg_cost")


# --- guardrails, quality --------------------------------------------------------------

_TICKET = ("ticket", r"\b[A-Z]{2}-\d{4,6}\b", "medium", "[TICKET]")


@query("SELECT call_id, CAST(len(regexp_extract_all(prompt, '\\b[A-Z]{2}-\\d{4,6}\\b', 0, 'i')) AS BIGINT) AS tickets, md5(regexp_replace(prompt, '\\b[A-Z]{2}-\\d{4,6}\\b', '[TICKET]', 'gi')) AS redacted FROM (SELECT DISTINCT call_id, prompt FROM llm_calls)")
def pii_custom_detector(spark, sf):
    """A detector of one's own, alone: matches and the redacted text."""
    calls = load(spark, sf, "llm_calls", ["call_id", "prompt"]).distinct()
    counts = guard.pii_counts(F.col("prompt"), [_TICKET]).getField("ticket")
    return calls.select("call_id", counts.alias("tickets"), F.md5(guard.pii_redact(F.col("prompt"), [_TICKET]).cast("binary")).alias("redacted"))


@query("SELECT source, count(*) AS rows, count(*) FILTER (prompt IS NULL) AS null_prompt, round(avg(CASE WHEN response IS NULL THEN 1.0 ELSE 0.0 END), 8) AS null_response FROM llm_calls GROUP BY 1")
def quality_by_label(spark, sf):
    """Null counts and rates of text columns per source."""
    rows = load(spark, sf, "llm_calls", ["source", "prompt", "response"])
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prompt").isNull()).alias("null_prompt"), F.avg(F.col("response").isNull().cast("double")).alias("null_response"))
    return rounded(found, 8, "null_response")


# --- streams, run over what is there --------------------------------------------------


def _events(spark, sf):
    return files.parquet_stream(spark, f"{sf}/events.parquet")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_hourly(spark, sf):
    found = pipelines.run_now(pipelines.tumbling(_events(spark, sf), "ts", "1 hour", ["event_type"]), "complete")
    return rounded(_ntz(found, "window_start"), 4, "total")


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
def stream_sliding_two_hours(spark, sf):
    return _ntz(pipelines.run_now(pipelines.sliding(_events(spark, sf), "ts", "2 hours", "1 hour", ["event_type"]), "complete"), "window_start")


@query("SELECT event_id, CAST(length(props) AS VARCHAR) || ':' || substr(sha256(props), 1, 8) AS ai_response FROM (SELECT DISTINCT event_id, props FROM events)")
def stream_deduplicated_answers(spark, sf):
    """Events once each, with a model's answer on their properties."""
    rows = pipelines.answered(pipelines.deduplicated(_events(spark, sf), ["event_id"], "ts"), "props")
    return pipelines.run_now(rows.select("event_id", "ai_response"))


@query("SELECT user_id, event_id, admitted, stopped_by FROM (SELECT user_id, event_id, true AS admitted, CAST(NULL AS VARCHAR) AS stopped_by FROM events)")
def stream_rate_limits(spark, sf):
    """Admission on a stream with limits that the table's events keep."""
    from millrace.operators.ratelimit import Limits

    return pipelines.run_now(pipelines.limits(_events(spark, sf), "user_id", "ts", "event_id", Limits(1000, 1000, 1000)))
