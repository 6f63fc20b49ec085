"""Builders of the DuckDB counterparts that repeat per column or per table."""

from __future__ import annotations

#: Columns of the driver's tables with their kinds: i int, l bigint, d double, s string, b boolean, t timestamp, x nested.
TABLES = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:l c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:l s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:l p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:l l_partkey:l l_suppkey:l l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:l ts:t user_id:l event_type:s value:d props:s",
    "call_usage": "call_id:l user_id:s model:s provider:s source:s input_tokens:i output_tokens:i latency_ms:d cost_usd:d success:b ts:t logged_at:t",
    "rag_documents": "id:s content:s collection:s metadata:x created_at:t",
    "documents": "doc_id:l text:s lang:s source:s n_chars:l workspace_id:s created_at:t",
    "model_pricing": "model:s provider:s input_per_1k:d output_per_1k:d",
    "mix_targets": "mix_id:s source:s weight:d max_repeats:i total_share:d",
}


def columns(table: str) -> dict[str, str]:
    return dict(c.split(":") for c in TABLES[table].split())


def _absent(name: str, kind: str) -> str:
    return f"({name} IS NULL OR isnan({name}))" if kind == "d" else f"({name} IS NULL)"


def profile_sql(table: str, numeric: str = "ild") -> str:
    """Every metric of every column as a row of a UNION ALL."""
    rows = []
    for name, kind in columns(table).items():
        gone = _absent(name, kind)
        value = f"(CASE WHEN NOT {gone} THEN {name} END)"
        metrics = {
            "null_count": f"count(*) FILTER ({gone})",
            "null_rate": f"coalesce(avg(CASE WHEN {gone} THEN 1.0 ELSE 0.0 END), 0)",
            "total_count": "count(*)",
            "unique_count": f"count(DISTINCT {value})",
            "unique_rate": f"coalesce(count(DISTINCT {value}) / nullif(count(*), 0), 0)",
        }
        if kind in numeric:
            metrics |= {"min": f"min({value})", "max": f"max({value})", "mean": f"avg({value})", "median": f"quantile_cont(CAST({value} AS DOUBLE), 0.5)", "std": f"CASE WHEN count({value}) > 1 THEN stddev_samp({value}) END"}
        elif kind == "s":
            metrics |= {"min_length": f"min(length({name}))", "max_length": f"max(length({name}))", "avg_length": f"avg(length({name}))"}
        rows += [f"SELECT '{name}' AS column_name, '{m}' AS metric, round(CAST({e} AS DOUBLE), {8 if m.endswith('rate') else 4}) AS value FROM {table}" for m, e in metrics.items()]
    return " UNION ALL ".join(rows)


def score_sql(tables: list[str]) -> str:
    """Quality score of each table."""
    rows = []
    for table in tables:
        kinds = columns(table)
        rates = [f"avg(CASE WHEN {_absent(n, k)} THEN 1.0 ELSE 0.0 END)" for n, k in kinds.items()]
        high = " + ".join(f"(CASE WHEN {r} > 0.5 THEN 1 ELSE 0 END)" for r in rates)
        low = " + ".join(f"(CASE WHEN count(DISTINCT {n}) / count(*) < 0.9 THEN 1 ELSE 0 END)" for n in kinds if "id" in n.lower()) or "0"
        value = f"100 - 10 * ({high}) - 15 * ({low}) - 20 * ({' + '.join(rates)}) / {len(kinds)}"
        rows.append(f"SELECT '{table}' AS table_name, round(CAST(greatest(0, least(100, {value})) AS DOUBLE), 4) AS score, CAST({len(kinds)} AS BIGINT) AS columns, CAST(({high}) + ({low}) AS BIGINT) AS anomalies FROM {table}")
    return " UNION ALL ".join(rows)


def anomalies_sql(table: str) -> str:
    rows = []
    for name, kind in columns(table).items():
        rate = f"avg(CASE WHEN {_absent(name, kind)} THEN 1.0 ELSE 0.0 END)"
        rows.append(f"SELECT '{name}' AS column_name, 'high_null_rate' AS type, round({rate}, 6) AS value FROM {table} HAVING {rate} > 0.5")
        if "id" in name.lower():
            rows.append(f"SELECT '{name}', 'low_uniqueness', round(count(DISTINCT {name}) / count(*), 6) FROM {table} HAVING count(DISTINCT {name}) / count(*) < 0.9")
    return " UNION ALL ".join(rows)


def rules_sql(table: str) -> str:
    names = {"i": "INT", "l": "BIGINT", "d": "DOUBLE", "s": "STRING", "t": "TIMESTAMP_NTZ", "b": "BOOLEAN", "x": "MAP"}
    rows = []
    for name, kind in columns(table).items():
        low = name.lower()
        if any(k in low for k in ("id", "key", "_pk")):
            rows.append(f"SELECT '{name}' AS column_name, '{name}_not_null' AS rule, 'not_null' AS kind, 'critical' AS severity")
        if low == "id" or low.endswith("_id"):
            rows.append(f"SELECT '{name}', '{name}_unique', 'unique', 'high' FROM {table} HAVING count(DISTINCT {name}) / count(*) > 0.99")
        if kind in "ld" and ("INT" in names[kind] or "DOUBLE" in names[kind]):
            rows.append(f"SELECT '{name}', '{name}_positive', 'in_range', 'medium' FROM {table} HAVING min(CASE WHEN NOT {_absent(name, kind)} THEN {name} END) >= 0")
    return " UNION ALL ".join(rows)


def redact_sql(column: str, detectors: list[tuple[str, str, str, str]]) -> str:
    """Matches are found in the original and replaced, one after the other, in the text so far."""
    out = column
    for _, pattern, _, tag in detectors:
        quoted = pattern.replace("'", "''")
        out = f"coalesce(list_reduce(list_prepend({out}, regexp_extract_all({column}, '{quoted}', 0, 'i')), lambda a, m: replace(a, m, '{tag}')), {out})"
    return out
