"""Bronze, silver and gold tables as functions from frame to frame, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.quality import Expectation, enforce


def bronze(raw: DataFrame) -> DataFrame:
    """Raw rows with the time of ingestion."""
    return raw.withColumn("ingested_at", F.current_timestamp())


def silver(rows: DataFrame, key: list[str], expectations: list[Expectation], event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows that meet the expectations, once per key. On a stream the keys are forgotten `delay` behind the watermark."""
    kept = enforce(rows, expectations)
    if kept.isStreaming:
        if event_time is None:
            raise ValueError("a stream needs an event time, or its keys would be kept for ever")
        return kept.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    return kept.dropDuplicates(key)


def gold(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    """count, sum and mean of an amount per category."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.sum(amount).alias("total"), F.avg(amount).alias("average"))


def standardised(df: DataFrame, types: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Columns cast by try_cast (a value that does not fit is null), then nulls filled."""
    for name, kind in types.items():
        df = df.withColumn(name, F.col(name).try_cast(kind))
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def history(changes: DataFrame, key: list[str], ts: str, attributes: list[str]) -> DataFrame:
    """Slowly changing dimension, type 2: (key, attributes, valid_from, valid_to, is_current); repeats of the same attributes are one row."""
    order = W.partitionBy(*key).orderBy(ts)
    state = F.struct(*attributes)
    changed = changes.withColumn("__before", F.lag(state).over(order)).filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(state))
    until = F.lead(ts).over(order)
    return changed.select(*key, *attributes, F.col(ts).alias("valid_from"), until.alias("valid_to"), until.isNull().alias("is_current"))


def masked(df: DataFrame, columns: list[str], allowed: bool, mask: Column | None = None) -> DataFrame:
    """Columns in the clear for those who may see them, else letters, digits and the like masked."""
    if allowed:
        return df
    for name in columns:
        df = df.withColumn(name, mask if mask is not None else F.mask(F.col(name).cast("string")))
    return df


def row_filtered(df: DataFrame, owner: str, groups: list[str], admin: bool = False) -> DataFrame:
    """Rows of the caller's groups only; an administrator sees all."""
    return df if admin else df.filter(F.col(owner).isin(*groups) if groups else F.lit(False))
