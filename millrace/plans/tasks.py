"""Jobs of an analyst or engineer as one call each, made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import profile, quality
from millrace.plans import texts


def analysed(df: DataFrame, columns: str | list[str] = "all") -> dict[str, DataFrame]:
    """The profile of a table, its anomalies and its score; the figures are computed once each, when read."""
    long = profile.profile(df, columns)
    return {"profile": long, "anomalies": quality.anomalies(long), "score": quality.score(long)}


def compared(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Differences of two tables in schema, rows (where the schemas agree) and statistics."""
    out = {"schema": quality.compare_schemas(a, b), "statistics": quality.compare_profiles(a, b)}
    if [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]:
        out["rows"] = quality.compare_rows(a, b)
    return out


def quality_plan(df: DataFrame, name: str) -> dict:
    """Rules that the data suggest, as expectations, as a schema entry and as the statement that makes the table."""
    found = [quality.Expectation(r.rule, r.column_name, r.kind, r.severity, {"min": 0} if r.kind == "in_range" else {}) for r in quality.rules(df).collect()]
    return {"expectations": found, "entry": texts.model_entry(name, "", found), "ddl": texts.ddl(name, df.schema)}
