"""Sinks and table changes. Parquet tables are immutable: a change writes a new path, append-only logs append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import audit_hash


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_chunks(chunks: DataFrame, table: str) -> None:
    """Appends chunks, without their embeddings, to a managed table; an index name loses its last `_index`."""
    target = table[: -len("_index")] if table.endswith("_index") else table
    chunks.drop("embedding").write.mode("append").saveAsTable(target)


def delete(spark: SparkSession, source: str, target: str, keys: DataFrame, key: str) -> None:
    """Rewrites a table without the given keys to a new path."""
    spark.read.parquet(source).join(keys.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(target)


def truncate(spark: SparkSession, source: str, target: str) -> None:
    """Writes an empty table of the same schema."""
    spark.read.parquet(source).limit(0).write.mode("overwrite").parquet(target)


def merge(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """MERGE by key: matched rows take the change's values (null ones keep the old), new keys are added."""
    names = [c for c in target.columns if c not in key]
    a, b = target.alias("t"), changes.alias("c")
    on = None
    for k in key:
        same = F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}"))
        on = same if on is None else on & same
    pick = lambda c: F.coalesce(F.col(f"c.{c}"), F.col(f"t.{c}")).alias(c) if c in changes.columns else F.col(f"t.{c}").alias(c)
    return a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"c.{k}"), F.col(f"t.{k}")).alias(k) for k in key], *[pick(c) for c in names])


def create_as(df: DataFrame, table: str, partitioned_by: list[str] | None = None, replace: bool = False) -> None:
    """CREATE TABLE AS: a managed table of the rows; an existing one is an error, or replaced."""
    writer = df.write.mode("overwrite" if replace else "errorifexists")
    (writer.partitionBy(*partitioned_by) if partitioned_by else writer).saveAsTable(table)


def clone(spark: SparkSession, source: str, target: str) -> None:
    """A deep copy of a table, its partitioning included, that later changes of the source do not reach."""
    columns = [c.name for c in spark.catalog.listColumns(source) if c.isPartition]
    create_as(spark.table(source), target, columns or None)


def clustered(df: DataFrame, columns: list[str], files: int) -> DataFrame:
    """Rows range-partitioned and sorted by columns, so that file statistics prune reads."""
    return df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)


def audit_rows(requests: DataFrame, prompt: str, response: str, user: str, ts: str, metadata: Column | None = None) -> DataFrame:
    """(ts, user_id, prompt_hash, prompt_length, response_length, metadata): texts are hashed, not kept."""
    return requests.select(
        F.col(ts).alias("ts"),
        F.col(user).alias("user_id"),
        audit_hash(F.col(prompt)).alias("prompt_hash"),
        F.length(prompt).cast("bigint").alias("prompt_length"),
        F.coalesce(F.length(response), F.lit(0)).cast("bigint").alias("response_length"),
        (metadata if metadata is not None else F.lit("{}")).alias("metadata"),
    )


def audit_log(requests: DataFrame, path: str, **columns) -> None:
    """Appends audit rows as JSON lines."""
    audit_rows(requests, **columns).write.mode("append").json(path)


def with_run_metrics(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows and an observation whose metrics are known once an action has run over them; no extra pass."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
