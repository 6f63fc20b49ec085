"""Table profiles in one pass over the data, as long rows (column_name, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILER_NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
QUALITY_NUMERIC = (T.LongType, T.DoubleType)
#: Exact distinct counts that share one scan; a row goes out once per count, with that column only (Expand).
DISTINCTS_AT_ONCE = 6
#: Bytes of input, as the planner knows them, above which a profile takes sketches unless exact figures are asked for.
EXACT_BYTES = 8 << 30


def is_absent(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def chosen(df: DataFrame, columns: str | list[str] = "all") -> list[str]:
    """"all", a comma list or a list of names; unknown names are passed over."""
    if columns == "all":
        return df.columns
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else columns
    return [c for c in names if c in df.columns]


def _value(df: DataFrame, name: str) -> Column:
    return F.when(~is_absent(df, name), F.col(f"`{name}`"))


def _hashable(df: DataFrame, name: str) -> Column:
    """Distinct counts of maps go over their sorted entries."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.array_sort(F.map_entries(f"`{name}`"))
    return _value(df, name)


def profile(df: DataFrame, columns: str | list[str] = "all", numeric: tuple = PROFILER_NUMERIC, approximate: bool | None = None) -> DataFrame:
    """null_count, null_rate, unique_count, unique_rate and total_count of every column;
    min, max, mean, median and std of numeric ones; min, max and mean length of strings.

    All metrics of all columns but medians come from one aggregation, which is then unpivoted.
    Exact distinct counts run DISTINCTS_AT_ONCE to a scan. `approximate` takes HyperLogLog
    counts (2 %) and a quantile sketch for the median (1 in 10,000), whose exact form holds all
    distinct values, within the same single pass; None, the default, does so for inputs of over
    EXACT_BYTES. False gives exact figures at any size.
    An empty table gives counts of 0, rates of 0 and null statistics. NaN counts as null.
    """
    if approximate is None:
        approximate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > EXACT_BYTES and _is_read(df)
    names = chosen(df, columns)
    total = F.count(F.lit(1))
    rate = lambda n: F.coalesce(F.try_divide(n, total), F.lit(0.0))
    metrics: dict[tuple[str, str], Column] = {}
    for name in names:
        kind, value = df.schema[name].dataType, _value(df, name)
        metrics[name, "null_count"] = F.count_if(is_absent(df, name))
        metrics[name, "null_rate"] = rate(F.count_if(is_absent(df, name)))
        metrics[name, "total_count"] = total
        if isinstance(kind, numeric):
            number = value.cast("double")
            metrics |= {(name, "min"): F.min(number), (name, "max"): F.max(number), (name, "mean"): F.avg(number), (name, "median"): F.percentile_approx(number, 0.5, 10_000) if approximate else F.percentile(number, F.lit(0.5)), (name, "std"): F.stddev_samp(number)}
        elif isinstance(kind, T.StringType):
            length = F.length(value)
            metrics |= {(name, "min_length"): F.min(length), (name, "max_length"): F.max(length), (name, "avg_length"): F.avg(length)}
        if approximate:
            metrics[name, "unique_count"] = F.approx_count_distinct(_hashable(df, name), 0.02)
            metrics[name, "unique_rate"] = rate(F.approx_count_distinct(_hashable(df, name), 0.02))
    # Medians are object aggregates: beside them all others would leave generated code.
    medians = [k for k in metrics if k[1] == "median"]
    parts = []
    for keys in ([k for k in metrics if k[1] != "median"], medians):
        if keys:
            parts.append(_unpivoted(df.agg(*[metrics[key].cast("double").alias(f"m{k}") for k, key in enumerate(keys)]), keys))
    if not approximate:
        for at in range(0, len(names), DISTINCTS_AT_ONCE):
            group = names[at : at + DISTINCTS_AT_ONCE]
            found = df.agg(*[F.count_distinct(_hashable(df, n)).alias(f"n{k}") for k, n in enumerate(group)], total.alias("rows"))
            values = [c for k in range(len(group)) for c in (F.col(f"n{k}").cast("double"), F.coalesce(F.try_divide(f"n{k}", "rows"), F.lit(0.0)))]
            wide = found.select(*[c.alias(f"m{k}") for k, c in enumerate(values)])
            parts.append(_unpivoted(wide, [(n, m) for n in group for m in ("unique_count", "unique_rate")]))
    out = parts[0] if parts else _unpivoted(df.limit(0), [])
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _is_read(df: DataFrame) -> bool:
    """Whether the planner's size comes from files; without them it is a default beyond any size."""
    return bool(df.inputFiles())


def _unpivoted(wide: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    if not keys:
        return wide.sparkSession.createDataFrame([], "column_name string, metric string, value double")
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(m).alias("metric"), F.col(f"m{k}").alias("value")) for k, (n, m) in enumerate(keys)])
    return wide.select(F.inline(rows))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, count, place) of the k most frequent values; nulls left out, ties by value."""
    counts = df.filter(~is_absent(df, column)).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(k)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("count"), F.asc("value"))))


def samples(df: DataFrame, column: str, order_by: str, k: int = 5) -> DataFrame:
    """The first k values of a column that are not null, in the order of another column."""
    return df.filter(~is_absent(df, column)).orderBy(order_by).select(F.col(f"`{column}`").alias("value")).limit(k)


def deterministic_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """About `share` of the rows, the same on every run: those whose key's hash falls below it."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


def sketch_of(df: DataFrame, rows: int = 5) -> dict:
    """Driver-side sample for a prompt's context: schema tree, row count, first rows."""
    return {"schema": df.schema.simpleString(), "rows": df.count(), "sample": [r.asDict() for r in df.limit(rows).collect()]}


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column_name, data_type, nullable, comment) from the schema; no data are read."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment", "")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, nullable boolean, comment string")
