"""Similarity search over chunk and cache embeddings by exact comparison, and retrieval context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.vectors import usable

#: Queries multiplied with a batch at once, and bytes of query vectors that one read of the collection serves.
BLOCK, READ_BYTES = 1024, 64 << 20


def top_k(queries: DataFrame, items: DataFrame, k: int | None = 5, dim: int = 128, threshold: float | None = None, per: str | None = None) -> DataFrame:
    """(query_id, item_id, score, place): the k items of highest cosine for each query (id, embedding); all above `threshold` if k is None.

    A stated query set against all rows: the queries are read when the plan is made and sent
    out in sets of at most READ_BYTES (65,000 of 128 numbers), each of which takes one read of
    the collection, whose batches are multiplied with blocks of it. At most k rows per query
    and batch leave a task; items are never shuffled. For as many queries as items there is
    the index of problem 4. `threshold` keeps scores strictly above it; `per` names a column
    that query and item must share (the model). Ties go to the smaller id. Vectors that are
    null, of another length or not finite take no part; zero vectors score 0.
    """
    if k is None and threshold is None:
        raise ValueError("give k, a threshold, or both")
    spark = queries.sparkSession
    asked = queries.filter(usable(F.col("embedding"), dim)).select("id", "embedding", *([per] if per else []))
    stored = items.filter(usable(F.col("embedding"), dim)).select("id", "embedding", *([per] if per else []))
    out = None
    for part in _sets(asked, per, max(1, READ_BYTES // (8 * dim))):
        found = stored.mapInArrow(_scorer(spark.sparkContext.broadcast(part), k, threshold, bool(per), dim), "query_id string, item_id string, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id string, item_id string, score double, place int")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    ranked = out.withColumn("place", place)
    return ranked if k is None else ranked.filter(F.col("place") <= k)


def _sets(asked: DataFrame, per: str | None, most: int) -> Iterator[dict]:
    """Sets of at most `most` queries, by group (None without groups): (ids, unit vectors). They stream through the driver."""

    def packed() -> dict:
        return {g: (np.array(ids, dtype=object), _unit(np.array(vectors, dtype=np.float64))) for g, (ids, vectors) in groups.items()}

    groups, held = {}, 0
    for r in asked.toLocalIterator(prefetchPartitions=True):
        ids, vectors = groups.setdefault(r[per] if per else None, ([], []))
        ids.append(str(r.id))
        vectors.append(r.embedding)
        held += 1
        if held == most:
            yield packed()
            groups, held = {}, 0
    if held:
        yield packed()


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _scorer(shared, k: int | None, threshold: float | None, grouped: bool, dim: int):
    def scored(names: np.ndarray, asked: np.ndarray, own: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(names), BLOCK):
            score = asked[at : at + BLOCK] @ x.T
            fine = score > (-np.inf if threshold is None else threshold)
            many = np.flatnonzero(fine.sum(axis=1) > k) if k is not None else []
            if len(many):  # all ties at the k-th place stay here; the places are given over all batches
                fine[many] &= score[many] >= np.partition(score[many], len(own) - k, axis=1)[:, len(own) - k][:, None]
            q, c = np.nonzero(fine)
            yield pa.RecordBatch.from_arrays([pa.array(names[at + q].tolist(), pa.string()), pa.array(own[c].tolist(), pa.string()), pa.array(score[q, c], pa.float64())], names=["query_id", "item_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(0).cast(pa.string()).to_pylist(), dtype=object)
            x = _unit(batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim))
            if not grouped:
                yield from scored(*shared.value[None], own, x)
                continue
            rows: dict = {}
            for at, group in enumerate(batch.column(2).to_pylist()):
                rows.setdefault(group, []).append(at)
            for group, at in rows.items():
                if group is not None and group in shared.value:
                    yield from scored(*shared.value[group], own[at], x[at])

    return run


def metadata_filter(items: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Items whose metadata hold every wanted value; a missing key or null metadata does not match."""
    for name, value in wanted.items():
        items = items.filter(F.coalesce(F.try_element_at(F.col(column), F.lit(name)) == F.lit(value), F.lit(False)))
    return items


def semantic_match(requests: DataFrame, entries: DataFrame, threshold: float = 0.95, dim: int = 128) -> DataFrame:
    """The best live entry of the same model strictly above `threshold` per request (id, model, embedding)."""
    return top_k(requests, entries, 1, dim, threshold, per="model").select("query_id", "item_id", "score")


def context(ranked: DataFrame, chunks: DataFrame, joint: str = "\n\n") -> DataFrame:
    """(query_id, context, total_results): contents of a query's items in rank order; k of them at most, as ranked."""
    found = ranked.join(chunks.select(F.col("id").alias("item_id"), "content").dropDuplicates(["item_id"]), "item_id")
    listed = F.array_sort(F.collect_list(F.struct("place", "content")))
    return found.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["content"]), joint).alias("context"), F.count(F.lit(1)).alias("total_results"))


def recent_messages(turns: DataFrame, conversation: str, order: list[Column], keep: int = 20) -> DataFrame:
    """The last `keep` messages of each conversation."""
    return turns.withColumn("place", F.row_number().over(W.partitionBy(conversation).orderBy(*order))).filter(F.col("place") <= keep)


def latest_versions(templates: DataFrame, name: str = "name", version: str = "version", added: str = "added_at") -> DataFrame:
    """The version of each template that was added last, not the highest."""
    return templates.groupBy(name).agg(F.max_by(version, added).alias(version))
