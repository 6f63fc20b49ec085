"""Data-quality rules, anomalies, score and executable expectations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import QUALITY_NUMERIC, is_absent, profile

KEY_LIKE = ("id", "key", "_pk")


@dataclass(frozen=True)
class Expectation:
    """A check on a column. Row kinds: not_null, in_range, in_set, regex; table kinds: unique, referential."""

    name: str
    column: str
    kind: str
    severity: str = "medium"
    parameters: dict = field(default_factory=dict)

    def holds(self) -> Column:
        """Row predicate, true where the expectation holds; a null value fails not_null only."""
        c, p = F.col(f"`{self.column}`"), self.parameters
        if self.kind == "not_null":
            return c.isNotNull()
        if self.kind == "in_range":
            low = c >= p["min"] if p.get("min") is not None else F.lit(True)
            high = c <= p["max"] if p.get("max") is not None else F.lit(True)
            return F.coalesce(low & high, F.lit(True))
        if self.kind == "in_set":
            return F.coalesce(c.isin(*p["values"]), F.lit(True))
        if self.kind == "regex":
            return F.coalesce(F.regexp_like(c, F.lit(p["pattern"])), F.lit(True))
        raise ValueError(f"{self.kind} is no row expectation")

    def rule(self) -> str:
        """The check as a line of SQL."""
        p = self.parameters
        return {
            "not_null": f"{self.column} IS NOT NULL",
            "in_range": " AND ".join(x for x in (f"{self.column} >= {p.get('min')}" if p.get("min") is not None else "", f"{self.column} <= {p.get('max')}" if p.get("max") is not None else "") if x),
            "in_set": f"{self.column} IN {tuple(p.get('values', ()))}",
            "regex": f"{self.column} RLIKE '{p.get('pattern')}'",
            "unique": f"COUNT(DISTINCT {self.column}) = COUNT(*)",
            "referential": f"{self.column} IN (SELECT {p.get('key')} FROM {p.get('table')})",
        }[self.kind]


def quality_profile(df: DataFrame, approximate: bool | None = None) -> DataFrame:
    """The long profile with statistics for bigint and double columns only."""
    return profile(df, "all", QUALITY_NUMERIC, approximate)


def _wide(long: DataFrame) -> DataFrame:
    metrics = ("null_count", "null_rate", "unique_count", "unique_rate", "total_count", "min", "max")
    return long.groupBy("column_name").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def rules(df: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """(column_name, rule, kind, severity) of the expectations that the profile suggests.

    Names with id, key or _pk: not null. Names that are id or end in _id with over 99 %
    distinct values: unique. Numbers whose minimum is in the profile and not negative: not
    negative; the quality profile has minima of bigint and double columns only, another
    profile given as `long` may have more.
    """
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString().upper()) for f in df.schema.fields], "column_name string, type string")
    known = types.join(_wide(long if long is not None else quality_profile(df)), "column_name", "left")
    low = F.lower("column_name")
    keyed = reduce(lambda a, b: a | b, [low.contains(k) for k in KEY_LIKE])
    number = F.col("type").contains("INT") | F.col("type").contains("DOUBLE") | F.col("type").contains("DECIMAL")
    single = (low.endswith("_id") | (low == "id")) & (F.coalesce("unique_count", F.lit(0.0)) / F.greatest(F.coalesce("total_count", F.lit(1.0)), F.lit(1.0)) > 0.99)
    entry = lambda suffix, kind, severity: F.struct(F.concat("column_name", F.lit(suffix)).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(F.when(keyed, entry("_not_null", "not_null", "critical")), F.when(single, entry("_unique", "unique", "high")), F.when(number & (F.col("min") >= 0), entry("_positive", "in_range", "medium"))))
    return known.select("column_name", F.inline(found))


def anomalies(long: DataFrame) -> DataFrame:
    """(column_name, type, value): null rates over a half; id-like names with under 90 % distinct values."""
    wide = _wide(long)
    unique = F.coalesce("unique_count", F.lit(0.0)) / F.greatest(F.coalesce("total_count", F.lit(1.0)), F.lit(1.0))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    found = F.array_compact(F.array(F.when(F.col("null_rate") > 0.5, entry("high_null_rate", F.col("null_rate"))), F.when(F.lower("column_name").contains("id") & (unique < 0.9), entry("low_uniqueness", unique))))
    return wide.select("column_name", F.inline(found))


def score(long: DataFrame) -> DataFrame:
    """(score, columns, anomalies): 100, less 10 per high null rate, 15 per low uniqueness and 20 times the mean null rate; 0 to 100."""
    wide = _wide(long)
    unique = F.coalesce("unique_count", F.lit(0.0)) / F.greatest(F.coalesce("total_count", F.lit(1.0)), F.lit(1.0))
    nulls = F.count_if(F.col("null_rate") > 0.5)
    low = F.count_if(F.lower("column_name").contains("id") & (unique < 0.9))
    value = 100 - 10 * nulls - 15 * low - 20 * F.coalesce(F.avg("null_rate"), F.lit(0.0))
    return wide.agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)).alias("score"), F.count(F.lit(1)).alias("columns"), (nulls + low).alias("anomalies"))


def score_table(df: DataFrame) -> DataFrame:
    """The score of a table in one aggregation: null rates of all columns, distinct counts of the id-like ones only."""
    from millrace.operators.profile import _hashable

    total = F.count(F.lit(1))
    rates = [F.coalesce(F.try_divide(F.count_if(is_absent(df, n)), total), F.lit(0.0)) for n in df.columns]
    keyed = [n for n in df.columns if "id" in n.lower()]
    unique = [F.coalesce(F.try_divide(F.count_distinct(_hashable(df, n)), total), F.lit(0.0)) for n in keyed]
    wide = df.agg(F.array(*rates).alias("rates"), F.array(*unique).cast("array<double>").alias("unique"))
    nulls, low = F.size(F.filter("rates", lambda r: r > 0.5)), F.size(F.filter("unique", lambda u: u < 0.9))
    mean = F.aggregate("rates", F.lit(0.0), lambda s, r: s + r) / max(1, len(df.columns))
    value = 100 - 10 * nulls - 15 * low - 20 * mean
    return wide.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)).alias("score"), F.lit(len(df.columns)).alias("columns"), (nulls + low).alias("anomalies"))


def violations(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """(name, kind, severity, violations) of row expectations, in one pass over the table."""
    wide = df.agg(*[F.count_if(~e.holds()).alias(f"v{k}") for k, e in enumerate(expectations)])
    rows = [F.struct(F.lit(e.name).alias("name"), F.lit(e.kind).alias("kind"), F.lit(e.severity).alias("severity"), F.col(f"v{k}").alias("violations")) for k, e in enumerate(expectations)]
    return wide.select(F.inline(F.array(*rows)))


def table_violations(df: DataFrame, expectations: list[Expectation], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(name, kind, severity, violations) of unique (rows that repeat an earlier value) and referential (orphan rows) expectations."""
    out = None
    for e in expectations:
        c = F.col(f"`{e.column}`")
        if e.kind == "unique":
            one = df.filter(c.isNotNull()).agg((F.count(F.lit(1)) - F.count_distinct(c)).alias("violations"))
        elif e.kind == "referential":
            one = orphans(df, e.column, (parents or {})[e.parameters["table"]], e.parameters["key"]).agg(F.count(F.lit(1)).alias("violations"))
        else:
            raise ValueError(f"{e.kind} is no table expectation")
        one = one.select(F.lit(e.name).alias("name"), F.lit(e.kind).alias("kind"), F.lit(e.severity).alias("severity"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def parse_expectations(reply: str, columns: list[str], most: int = 10) -> list[Expectation]:
    """Expectations of a model's reply that holds a JSON array of {column, type, ...}; unknown columns and kinds and any bad JSON give none."""
    import json
    import re

    found = re.search(r"\[.*\]", reply, re.DOTALL)
    try:
        items = json.loads(found.group(0)) if found else []
    except ValueError:
        return []
    made = []
    for x in items[:most] if isinstance(items, list) else []:
        kind = str(x.get("type", "")).lower() if isinstance(x, dict) else ""
        if kind in ("not_null", "in_range", "in_set", "regex", "unique") and x.get("column") in columns:
            made.append(Expectation(x.get("name") or f"{x['column']}_{kind}", x["column"], kind, str(x.get("severity", "medium")).lower(), x.get("parameters") or {}))
    return made


def enforce(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """Rows that meet all row expectations (the drop action)."""
    return df.filter(reduce(lambda a, b: a & b, [e.holds() for e in expectations], F.lit(True)))


def flag(df: DataFrame, expectations: list[Expectation], column: str = "failed") -> DataFrame:
    """All rows, with the names of the expectations each fails (the warn action)."""
    return df.withColumn(column, F.array_compact(F.array(*[F.when(~e.holds(), F.lit(e.name)) for e in expectations])))


def null_and_negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, negatives) of numeric columns."""
    wide = df.agg(*[c for k, n in enumerate(columns) for c in (F.count_if(is_absent(df, n)).alias(f"n{k}"), F.count_if(F.col(f"`{n}`") < 0).alias(f"g{k}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"n{k}").alias("nulls"), F.col(f"g{k}").alias("negatives")) for k, n in enumerate(columns)])))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row, and their counts; null keys form groups like others."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def table_unique(df: DataFrame, column: str) -> DataFrame:
    """(rows, distinct_values, is_unique) of a column; nulls are no value, so any null breaks uniqueness."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{column}`")).alias("distinct_values"))
    return found.withColumn("is_unique", F.col("rows") == F.col("distinct_values"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` whose non-null value is no key of `parent`."""
    keys = parent.select(F.col(f"`{key}`").alias("__key")).filter("__key is not null").distinct()
    return child.filter(F.col(f"`{column}`").isNotNull()).join(keys, F.col(f"`{column}`") == F.col("__key"), "left_anti")


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, type_a, type_b, status): same, retyped, only_a or only_b."""
    spark = a.sparkSession
    one = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in a.schema.fields], "column_name string, type_a string")
    two = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in b.schema.fields], "column_name string, type_b string")
    status = F.when(F.col("type_a").isNull(), "only_b").when(F.col("type_b").isNull(), "only_a").when(F.col("type_a") == F.col("type_b"), "same").otherwise("retyped")
    return one.join(two, "column_name", "full_outer").withColumn("status", status)


def compare_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows, repeats included, that only one side has. Columns are matched by position.

    One aggregation of whole rows with signed counts, combined before the shuffle. Nulls equal
    nulls and NaN equals NaN; maps are equal if their entries are.
    """
    names = [f"c{k}" for k in range(len(a.columns))]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        plain = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
        return df.select(*[c.alias(n) for c, n in zip(plain, names)], F.lit(sign).cast("bigint").alias("__sign"))

    left = signed(a, 1).union(signed(b, -1)).groupBy(*names).agg(F.sum("__sign").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0))
    both = left.agg(total(F.col("n")).alias("only_a"), total(-F.col("n")).alias("only_b"))
    return both.select(F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("rows")) for s in ("only_a", "only_b")])))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, metric, value_a, value_b, change) of two tables' profiles."""
    one, two = (p.withColumnRenamed("value", f"value_{s}") for p, s in ((profile(a), "a"), (profile(b), "b")))
    return one.join(two, ["column_name", "metric"], "full_outer").withColumn("change", F.col("value_b") - F.col("value_a"))


def suite_text(expectations: list[Expectation]) -> list[dict]:
    """Expectations as plain dictionaries for other tools: not_null, unique and in_range; others have no counterpart."""
    names = {"not_null": "expect_column_values_to_not_be_null", "unique": "expect_column_values_to_be_unique", "in_range": "expect_column_values_to_be_between"}
    return [{"expectation_type": names[e.kind], "kwargs": {"column": e.column} | ({"min_value": e.parameters.get("min"), "max_value": e.parameters.get("max")} if e.kind == "in_range" else {})} for e in expectations if e.kind in names]
