"""The semantic cache as data: replay, statistics, eviction, and changes to its table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import token_estimate
from millrace.operators.ratelimit import micros


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that have not expired: no expiry, or now not past it."""
    return entries.filter(F.col("expires_at").isNull() | (now <= F.col("expires_at").cast("timestamp")))


def lookup(entries: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Exact hits: requests (key, ...) with the live entry of their key; latest created wins if a key repeats."""
    newest = W.partitionBy("key").orderBy(F.desc("created_at"), "entry_id")
    unique = live(entries, now).withColumn("__n", F.row_number().over(newest)).filter("__n = 1").select("key", "entry_id", "response")
    return requests.join(unique, "key", "left").withColumn("hit", F.col("entry_id").isNotNull())


def replay(requests: DataFrame, key: list[str], ts: str, order: str, ttl_seconds: float) -> DataFrame:
    """(key..., order, hit) of a request log against an initially empty cache with a time to live.

    A miss stores the answer for `ttl_seconds`; a hit does not prolong it; exactly at the
    end it still serves. One shuffle by key and an ordered pass with one time as its state.
    A time to live of 0 or less never expires. Requests without a time are misses that store nothing.
    """
    ttl = int(ttl_seconds * 1_000_000)
    names = [*key, order]
    fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in names) + ", hit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, since = object(), None
        for batch in batches:
            hits = []
            for *k, at in zip(*(batch.column(c).to_pylist() for c in (*range(len(key)), len(names)))):
                if k != current:
                    current, since = k, None
                hit = at is not None and since is not None and (ttl <= 0 or at - since <= ttl)
                if not hit and at is not None:
                    since = at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.bool_())], names=[*names, "hit"])

    timed = requests.select(*names, micros(F.col(ts)).alias("__at"))
    return timed.repartition(*key).sortWithinPartitions(*key, "__at", order).mapInArrow(run, fields)


def hit_rate(replayed: DataFrame) -> DataFrame:
    """requests, hits, misses and hit_rate (0 without requests)."""
    hits, total = F.count_if("hit"), F.count(F.lit(1))
    return replayed.agg(total.alias("requests"), hits.alias("hits"), (total - hits).alias("misses"), F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("hit_rate"))


def running_latency(hits: DataFrame, partition: list[str], order: list[str], latency: str = "latency_ms") -> DataFrame:
    """Mean latency of the hits so far, per partition."""
    return hits.withColumn("mean_so_far", F.avg(latency).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def savings(hits: DataFrame, response: str = "response", times: Column | None = None, per_1k: float = 0.01) -> DataFrame:
    """Cost saved by hits: estimated tokens of the responses served, over 1,000, times the rate."""
    served = token_estimate(F.col(response)) * (times if times is not None else F.lit(1))
    return hits.agg(F.coalesce(F.sum(served) / 1000 * per_1k, F.lit(0.0)).alias("saved"))


def lru_hits(requests: DataFrame, key: str, ts: str, order: str, partition: list[str], capacity: int) -> DataFrame:
    """(partition..., order, hit) under least-recently-used eviction with `capacity` keys per partition.

    A request hits if fewer than `capacity` other keys were asked for since its key was last
    asked for (stack distance). Each partition (a tenant or shard of the cache) is walked in
    order with at most `capacity` keys in memory, so the number of partitions is the degree
    of parallelism.
    """
    names = [*partition, order, key]
    fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in names) + ", hit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = object(), {}
        for batch in batches:
            hits = []
            for *where, k in zip(*(batch.column(c).to_pylist() for c in (*range(len(partition)), len(partition) + 1))):
                if where != current:
                    current, stack = where, {}
                hits.append(k in stack)
                stack.pop(k, None)
                while len(stack) >= capacity:
                    stack.pop(next(iter(stack)))
                stack[k] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.bool_())], names=[*names, "hit"])

    timed = requests.select(*names, micros(F.col(ts)).alias("__at"))
    return timed.repartition(*partition).sortWithinPartitions(*partition, "__at", order).mapInArrow(run, fields)


def upsert(entries: DataFrame, changes: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """Entries with changes merged in by key: the newest row of a key wins, changes before entries on ties."""
    both = changes.withColumn("__side", F.lit(0)).unionByName(entries.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy(*key).orderBy(*newest, "__side"))
    return both.withColumn("__n", first).filter("__n = 1").drop("__n", "__side")


def touched(entries: DataFrame, accesses: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """Entries with hit_count and last_accessed brought up to date from an access log."""
    seen = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("__hits"), F.max(ts).alias("__last"))
    out = entries.join(seen, key, "left")
    return out.withColumn("hit_count", (F.coalesce("hit_count", F.lit(0)) + F.coalesce("__hits", F.lit(0))).cast("int")).withColumn("last_accessed", F.greatest("last_accessed", "__last")).drop("__hits", "__last")


def without_keys(entries: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Deletes by key; keys that are not there don't matter."""
    return entries.join(keys.select(key).distinct(), key, "left_anti")


def purge(entries: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entries left, one row with the number of purged ones)."""
    gone = entries.filter(F.col("expires_at").isNotNull() & (now > F.col("expires_at").cast("timestamp")))
    return live(entries, now), gone.agg(F.count(F.lit(1)).alias("evictions"))


def evict_oldest(entries: DataFrame, keep: int) -> DataFrame:
    """The `keep` most recently accessed entries (never accessed counts as created; without either, last).

    Counts per day give the day at which the kept ones end; only its rows are ranked.
    """
    rows = entries.withColumn("__at", F.coalesce("last_accessed", "created_at")).withColumn("__day", F.to_date("__at"))
    newer = W.orderBy(F.col("__d").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)  # one row a day
    days = rows.groupBy(F.col("__day").alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    days = days.withColumn("__before", F.coalesce(F.sum("__n").over(newer), F.lit(0))).filter(F.col("__before") < keep)
    kept = rows.join(days, F.col("__day").eqNullSafe(F.col("__d")))
    whole = F.col("__before") + F.col("__n") <= keep
    rank = F.row_number().over(W.partitionBy("__d").orderBy(F.col("__at").desc_nulls_last(), "entry_id"))
    edge = kept.filter(~whole).withColumn("__rank", rank).filter(F.col("__rank") <= keep - F.col("__before"))
    return kept.filter(whole).select(*entries.columns).unionByName(edge.select(*entries.columns))
