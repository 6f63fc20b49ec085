"""Percentiles of very large numeric columns by deterministic buffer collapsing (problem 3).

A sketch of a group holds at most one sorted buffer of `size` values per level, each
value of level h standing for 2**h rows, and a tail of fewer than `size` single rows.
Two full buffers of a level collapse into one of the next by taking every other value
of their sorted union, the start alternating between the first and the second. Merging
two sketches puts their tails and levels together and collapses again, so sketches of
partitions, days or clusters combine in any order.

Bound: a collapse at level h shifts a rank by at most 2**h, and a sketch of N rows makes
at most N / (size * 2**(h+1)) of them, so the rank error is at most
N * levels / (2 * size), levels = log2(N / size). With size = 2048 that is under 0.5 %
of N up to 10**9 rows and 0.8 % up to 10**13. Tails of merged sketches stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import write_once
from millrace.session import load

SIZE = 2048
#: Sketches of one group that a single merge task takes in.
FAN_IN = 64
PERCENTS = (50, 90, 95, 99)
#: Bytes of percentiles up to which they are broadcast to the values that they are checked with.
BROADCAST_BYTES = 8 << 20


class Sketch:
    """Levels of weighted sorted buffers and an unsorted tail."""

    def __init__(self, size: int = SIZE):
        self.size, self.tail, self.levels, self.flips = size, [], {}, {}
        self.tail_rows = 0

    def add(self, values: np.ndarray) -> None:
        """Takes single rows; NaN must be left out by the caller."""
        self.tail.append(values)
        self.tail_rows += len(values)
        if self.tail_rows >= self.size:
            rows = np.concatenate(self.tail)
            full = len(rows) // self.size * self.size
            self.tail, self.tail_rows = [rows[full:]], len(rows) - full
            for buffer in np.sort(rows[:full].reshape(-1, self.size), axis=1):
                self._push(0, buffer)

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while level in self.levels:
            both = np.concatenate([self.levels.pop(level), buffer])
            both.sort(kind="stable")
            start = self.flips[level] = 1 - self.flips.get(level, 1)
            buffer, level = both[start::2], level + 1
        self.levels[level] = buffer

    def merge(self, other: Sketch) -> None:
        for level in sorted(other.levels):
            self._push(level, other.levels[level])
        for rows in other.tail:
            self.add(rows)

    def rows(self) -> int:
        return self.tail_rows + sum(self.size << level for level in self.levels)

    def quantiles(self, fractions: list[float]) -> list[float | None]:
        """The smallest retained value whose weighted rank reaches ceil(fraction * rows); None when empty."""
        parts = [(np.concatenate(self.tail), 1)] if self.tail_rows else []
        parts += [(buffer, 1 << level) for level, buffer in self.levels.items()]
        if not parts:
            return [None] * len(fractions)
        values = np.concatenate([p for p, _ in parts])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(np.concatenate([np.full(len(p), w, dtype=np.int64) for p, w in parts])[order])
        total = int(ranks[-1])
        at = np.searchsorted(ranks, [max(1, int(np.ceil(f * total))) for f in fractions], side="left")
        return [float(x) for x in values[order][at]]

    def dump(self) -> bytes:
        levels = sorted(self.levels)
        head = np.array([self.size, self.tail_rows, len(levels), *levels, *[self.flips.get(x, 1) for x in levels]], dtype=np.int64)
        body = [np.concatenate(self.tail) if self.tail else np.empty(0), *[self.levels[x] for x in levels]]
        return head.tobytes() + np.concatenate(body).astype(np.float64).tobytes()

    @staticmethod
    def load(data: bytes) -> Sketch:
        size, tail, count = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=3))
        names = np.frombuffer(data, dtype=np.int64, count=2 * count, offset=24)
        body = np.frombuffer(data, dtype=np.float64, offset=24 + 16 * count)
        made = Sketch(size)
        made.tail, made.tail_rows = ([body[:tail]] if tail else []), tail
        for k in range(count):
            made.levels[int(names[k])] = body[tail + k * size : tail + (k + 1) * size]
            made.flips[int(names[k])] = int(names[count + k])
        return made


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def build_sketches(df: DataFrame, keys: list[str], value_cols: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per partition, key and value column: (keys..., metric, sketch, part).

    Narrow: a map-side combine, so a key that holds a third of all rows leaves each
    partition as one sketch of bounded size. Nulls and NaN are left out; infinities,
    zeros and negative values count. A null key is a key of its own.
    """
    fields = f"{_key_fields(df, keys)}, metric string, sketch binary, part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made: dict = {}
        for batch in batches:
            codes, names = None, []
            for k in range(len(keys)):
                coded = batch.column(k).dictionary_encode()
                index = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                values = [*coded.dictionary.to_pylist(), None]
                names.append(values)
                codes = index if codes is None else codes * len(values) + index
            order = np.argsort(codes, kind="stable") if keys else np.arange(batch.num_rows)
            sorted_codes = codes[order] if keys else np.zeros(batch.num_rows, dtype=np.int64)
            starts = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])) if batch.num_rows else []
            columns = [batch.column(len(keys) + v).to_numpy(zero_copy_only=False).astype(np.float64)[order] for v in range(len(value_cols))]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                code, key = int(sorted_codes[a]), []
                for values in reversed(names):
                    code, at = divmod(code, len(values))
                    key.append(values[at])
                key = tuple(reversed(key))
                for name, column in zip(value_cols, columns):
                    part = column[a:b]
                    part = part[~np.isnan(part)]
                    if len(part):
                        (made.get((key, name)) or made.setdefault((key, name), Sketch(size))).add(part)
        part_id = TaskContext.get().partitionId()
        yield _sketch_batch(keys, made, key_types, part_id)

    key_types = [f.dataType for f in df.select(*keys).schema.fields]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in value_cols]).mapInArrow(run, fields)


def _sketch_batch(keys: list[str], made: dict, key_types: list, part: int) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    arrays = [pa.array([key[k] for key, _ in made], type=to_arrow_type(key_types[k])) for k in range(len(keys))]
    arrays += [pa.array([name for _, name in made], type=pa.string()), pa.array([s.dump() for s in made.values()], type=pa.binary()), pa.array([part] * len(made), type=pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "metric", "sketch", "part"])


def merge_sketches(sketches: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """One sketch per key and metric. A tree: each step merges at most FAN_IN partitions' sketches of a key.

    `parts` is the number of partitions the sketches come from (an upper bound), which
    fixes the depth of the tree. Also combines days into longer periods: pass fewer keys.
    """
    fields = f"{_key_fields(sketches, keys)}{', ' if keys else ''}metric string, sketch binary, part int"

    def merged(table: pa.Table) -> pa.Table:
        whole = Sketch.load(table.column("sketch")[0].as_py())
        for k in range(1, table.num_rows):
            whole.merge(Sketch.load(table.column("sketch")[k].as_py()))
        first = table.slice(0, 1)
        return first.select([*keys, "metric"]).append_column("sketch", pa.array([whole.dump()], type=pa.binary())).append_column("part", pa.array([first.column("part")[0].as_py()], type=pa.int32()))

    rows = sketches.select(*keys, "metric", "sketch", "part")
    while True:
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", (F.col("part") / FAN_IN).cast("int") if parts > 1 else F.lit(0))
        rows = rows.groupBy(*keys, "metric", "part").applyInArrow(merged, fields)
        if parts <= 1:
            return rows


def read_percentiles(sketches: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(keys..., metric, n, p50, ...) of merged sketches."""
    fields = f"{_key_fields(sketches, keys)}{', ' if keys else ''}metric string, n bigint, " + ", ".join(f"p{p} double" for p in percents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [Sketch.load(x) for x in batch.column(len(keys) + 1).to_pylist()]
            values = [s.quantiles([p / 100 for p in percents]) for s in read]
            arrays = [*batch.columns[: len(keys) + 1], pa.array([s.rows() for s in read], type=pa.int64())]
            arrays += [pa.array([v[k] for v in values], type=pa.float64()) for k in range(len(percents))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "metric", "n", *[f"p{p}" for p in percents]])

    return sketches.select(*keys, "metric", "sketch").mapInArrow(run, fields)


def distinct_calls(calls: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each id once (deliveries of an id carry the same figures); rows without an id each count."""
    named = calls.filter(F.col(id_col).isNotNull()).select(id_col, *columns).dropDuplicates([id_col])
    unnamed = calls.filter(F.col(id_col).isNull()).select(id_col, *columns)
    return named.unionByName(unnamed)


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sketches per model and day of ts (UTC), the form to keep for later combination."""
    calls = load(spark, sf_dir, "call_usage", ["call_id", "model", "ts", "latency_ms", "cost_usd"])
    calls = calls.withColumn("day", F.to_date("ts")).select("call_id", "model", "day", "latency_ms", "cost_usd")
    rows = distinct_calls(calls, "call_id", ["model", "day", "latency_ms", "cost_usd"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) + 1 + calls.rdd.getNumPartitions()
    built = build_sketches(rows, ["model", "day"], ["latency_ms", "cost_usd"])
    return merge_sketches(built, ["model", "day"], parts)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per model and day, and per model and week, month and all time, combined from the days' sketches.

    `start` is the first day of the period (null for all time, and for calls without ts).
    """
    daily = write_once(daily_sketches(spark, sf_dir))  # bounded sketches, read twice
    by_day = read_percentiles(daily, ["model", "day"]).select("model", F.lit("day").alias("period"), F.col("day").alias("start"), "metric", "n", *[f"p{p}" for p in PERCENTS])
    periods = F.array(*[F.struct(F.lit(name).alias("period"), start.alias("start")) for name, start in (("week", F.to_date(F.date_trunc("week", "day"))), ("month", F.to_date(F.date_trunc("month", "day"))), ("all", F.lit(None).cast("date")))])
    spread = daily.withColumn("p", F.explode(periods)).select("model", "p.period", "p.start", "metric", "sketch", F.coalesce(F.pmod(F.datediff("day", F.lit("1970-01-01")), F.lit(FAN_IN * FAN_IN)), F.lit(0)).alias("part"))
    keys = ["model", "period", "start"]
    longer = read_percentiles(merge_sketches(spread, keys, FAN_IN * FAN_IN), keys)
    return by_day.unionByName(longer)


def p3_rank_errors(spark: SparkSession, sf_dir: str, bound: float = 0.01) -> DataFrame:
    """(model, period, start, metric, n, within) per row of `p3_percentiles`: the number of values by an exact count, and whether all ranks are within `bound` of the wanted ones.

    The percentiles meet every value of their group: a row counts, per percentile, the values
    below and up to it. Counts are combined before they are shuffled.
    """
    found = write_once(p3_percentiles(spark, sf_dir))
    calls = load(spark, sf_dir, "call_usage", ["call_id", "model", "ts", "latency_ms", "cost_usd"])
    calls = distinct_calls(calls.withColumn("day", F.to_date("ts")), "call_id", ["model", "day", "latency_ms", "cost_usd"])
    starts = {"day": F.col("day"), "week": F.to_date(F.date_trunc("week", "day")), "month": F.to_date(F.date_trunc("month", "day")), "all": F.lit(None).cast("date")}
    periods = F.array(*[F.struct(F.lit(name).alias("period"), start.alias("start")) for name, start in starts.items()])
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("latency_ms", "cost_usd")])
    values = calls.select("model", F.explode(periods).alias("p"), metrics.alias("m")).select("model", "p.*", F.explode("m").alias("m")).select("model", "period", "start", "m.*")
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = ["model", "period", "start", "metric"]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"f.{k}"))
    near = F.broadcast(found) if 128 * found.count() <= BROADCAST_BYTES else found
    both = values.alias("v").join(near.alias("f"), same)
    parts = [F.count_if(F.col("v.value") < F.col(f"f.p{p}")).alias(f"below{p}") for p in PERCENTS]
    parts += [F.count_if(F.col("v.value") <= F.col(f"f.p{p}")).alias(f"upto{p}") for p in PERCENTS]
    ranks = both.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), *parts)
    within = F.lit(True)
    for p in PERCENTS:
        wanted = F.ceil(F.col("n") * p / 100)
        within = within & (F.col(f"below{p}") < wanted + bound * F.col("n")) & (F.col(f"upto{p}") >= wanted - bound * F.col("n"))
    return ranks.select(*keys, "n", within.alias("within"))


QUERIES = {"p3_percentiles": p3_percentiles, "p3_rank_errors": p3_rank_errors}

#: The groups and their sizes; that all ranks are within the bound is what the operator promises.
ORACLES = {
    "p3_rank_errors": """WITH c AS (SELECT DISTINCT ON (call_id) model, CAST(ts AS DATE) AS day, latency_ms, cost_usd FROM call_usage),
      v AS (SELECT model, day, 'latency_ms' AS metric, latency_ms AS value FROM c UNION ALL SELECT model, day, 'cost_usd', cost_usd FROM c),
      p AS (SELECT model, metric, 'day' AS period, day AS start FROM v WHERE value IS NOT NULL AND NOT isnan(value) UNION ALL SELECT model, metric, 'week', CAST(date_trunc('week', day) AS DATE) FROM v WHERE value IS NOT NULL AND NOT isnan(value)
        UNION ALL SELECT model, metric, 'month', CAST(date_trunc('month', day) AS DATE) FROM v WHERE value IS NOT NULL AND NOT isnan(value) UNION ALL SELECT model, metric, 'all', NULL FROM v WHERE value IS NOT NULL AND NOT isnan(value))
      SELECT model, period, start, metric, count(*) AS n, true AS within FROM p GROUP BY 1, 2, 3, 4"""
}
