"""Pieces shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir


#: Counters of a table of frequencies, and the slices in which they are summed.
COUNTERS, SLICES = 1 << 20, 64


def write_once(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, for results that are read more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def first_per_id(df: DataFrame, id_col: str) -> DataFrame:
    """One row per id; rows without an id take no part. A repeated id is the same row again."""
    return df.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `edges` (a, b); a component is named by its smallest node.

    Alternating large-star and small-star rounds: each is one aggregation and one join on
    the edge list, the number of rounds grows with the logarithm of the longest chain, and
    every round's edges are written to the checkpoint folder. Nothing comes to the driver
    but two numbers a round.
    """
    edges = write_once(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = write_once(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def by_low_bits(batch: pa.RecordBatch) -> np.ndarray:
    """The counters of packed 64-bit hashes: their low bits."""
    return (np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_table(rows: DataFrame, *columns: str, counters: Callable[[pa.RecordBatch], np.ndarray] = by_low_bits) -> np.ndarray:
    """How often each of COUNTERS counters occurs among those that `counters` finds in batches of the columns.

    One table a task, summed slice by slice as a stream; the driver gets the sums, 4 MB
    whatever the rows. What shares a counter looks more frequent than it is, never rarer.
    """
    width = COUNTERS // SLICES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            at, n = np.unique(counters(batch), return_counts=True)
            table[at] += n.astype(np.uint32)
        parts = [(k, pa.compress(table[k * width : (k + 1) * width].tobytes(), codec="zstd", asbytes=True)) for k in range(SLICES) if table[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["slice", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(pa.decompress(x, 4 * width, codec="zstd", asbytes=True), dtype=np.uint32)
                sums[k] = sums[k] + counts if k in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    fields = "slice int, counts binary"
    table = np.zeros(COUNTERS, dtype=np.uint32)
    for r in rows.select(*columns).mapInArrow(counted, fields).repartition("slice").mapInArrow(summed, fields).collect():
        table[r.slice * width : (r.slice + 1) * width] += np.frombuffer(r.counts, dtype=np.uint32)
    return table
