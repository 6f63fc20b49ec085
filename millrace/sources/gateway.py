"""Guarded SQL: only statements that begin with an allowed word run, and results are limited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.guard import SAFE_WORDS


class Refused(ValueError):
    """The statement is not allowed."""


@dataclass
class Result:
    columns: list[str]
    rows: list[dict]
    total_rows: int


def check(statement: str, allowed: tuple[str, ...] = SAFE_WORDS) -> str:
    words = statement.strip().split(None, 1)
    word = words[0].upper() if words else ""
    if word not in allowed:
        raise Refused(f"operation not allowed: {word or '(blank)'}")
    return statement


def query(spark: SparkSession, statement: str, parameters: dict | None = None, allowed: tuple[str, ...] = SAFE_WORDS) -> DataFrame:
    """The lazy result of an allowed statement; values go in by parameter markers, never by text."""
    return spark.sql(check(statement, allowed), args=parameters or {})


def run(spark: SparkSession, statement: str, max_rows: int = 100, **options) -> Result:
    """Collects up to `max_rows` rows; only if the limit was reached does a second job count them all."""
    df = query(spark, statement, **options)
    rows = [r.asDict(recursive=True) for r in df.limit(max_rows).collect()]
    return Result(df.columns, rows, len(rows) if len(rows) < max_rows else df.count())


def explain(spark: SparkSession, statement: str) -> str:
    """The extended plan of an allowed statement, without running it."""
    return query(spark, statement)._jdf.queryExecution().toString()


def register(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """Temporary views of the tables of a data directory."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], block: str = "week") -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time; a null key has none.

    A union of both sides and an ordered window, instead of a range join. The window covers a
    `block` of time (a unit of date_trunc) of a key, and the last right row of earlier blocks
    comes from one row per key and block, so a key with very many rows is many tasks.
    Ties in time: the right row comes first; among equal right rows the last in `columns` order.
    """
    from pyspark.sql import Window as W

    mark = F.struct(*columns)
    a = left.select("*", F.lit(1).alias("__side"), F.lit(None).cast(right.select(mark.alias("x")).schema["x"].dataType).alias("__mark"))
    b = right.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__side"), mark.alias("__mark"))
    known = b.dropna(subset=by)
    both = a.unionByName(known).withColumn("__block", F.date_trunc(block, F.col(at)))
    newest = both.groupBy(*by, "__block").agg(F.max(F.when(F.col("__side") == 0, F.struct(at, "__mark"))).alias("__newest"))
    earlier = W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = newest.select(*by, "__block", F.last("__newest", ignorenulls=True).over(earlier)["__mark"].alias("__before")).filter("__before IS NOT NULL")
    order = W.partitionBy(*by, "__block").orderBy(F.col(at), F.col("__side"), F.col("__mark")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__last", F.last("__mark", ignorenulls=True).over(order)).filter("__side = 1").join(carried, [*by, "__block"], "left")
    last = F.coalesce("__last", "__before")
    return found.select(*[F.col(f"`{c}`") for c in left.columns], *[last[c].alias(f"asof_{c}") for c in columns])
