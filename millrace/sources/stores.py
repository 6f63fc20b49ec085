"""Stores behind small interfaces, so that embeddings, vector tables and cache backends can be exchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import cache_key
from millrace.functions.vectors import hash_embedding
from millrace.operators import cache, rag

CHUNKS = "id string, content string, document_id string, chunk_index int, metadata map<string,string>, embedding array<double>"
ENTRIES = "entry_id string, key string, prompt string, response string, model string, created_at timestamp, expires_at timestamp, hit_count int, last_accessed timestamp"


class VectorStore(Protocol):
    """What retrieval needs of a store of chunks."""

    def add(self, chunks: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def clear(self) -> None: ...
    def size(self) -> int: ...
    def search(self, questions: DataFrame, k: int | None = None, wanted: dict[str, str] | None = None) -> DataFrame: ...


class CacheBackend(Protocol):
    """What the cache needs of its table."""

    def read(self) -> DataFrame: ...
    def put(self, entries: DataFrame) -> None: ...
    def invalidate(self, requests: DataFrame) -> None: ...
    def clear(self) -> None: ...


class Versions:
    """A parquet table that every change writes anew, in a folder of its own; readers of an older version are not disturbed."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.current: str | None = None

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.current) if self.current else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> None:
        target = f"{self.folder}/{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names]).write.parquet(target)
        self.current = target


class TableStore:
    """A VectorStore over a versioned table; `embed` gives the vectors of chunks that have none, and of questions."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column] = hash_embedding, dim: int = 128):
        self.table, self.embed, self.dim = Versions(spark, folder, CHUNKS), embed, dim

    def add(self, chunks: DataFrame) -> None:
        self.table.replace(rag.add(self.table.read(), chunks, self.embed))

    def delete(self, ids: DataFrame) -> None:
        self.table.replace(cache.without_keys(self.table.read(), ids, "id"))

    def clear(self) -> None:
        self.table.replace(self.table.read().limit(0))

    def size(self) -> int:
        return self.table.read().count()

    def search(self, questions: DataFrame, k: int | None = None, wanted: dict[str, str] | None = None) -> DataFrame:
        return rag.retrieve(self.table.read(), questions, k, self.embed, self.dim, wanted)


class TableCache:
    """A CacheBackend over a versioned table; the newest entry of a key wins."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = Versions(spark, folder, ENTRIES)

    def read(self) -> DataFrame:
        return self.table.read()

    def put(self, entries: DataFrame) -> None:
        self.table.replace(cache.upsert(self.table.read(), entries, ["key"], [F.col("created_at").desc_nulls_last()]))

    def invalidate(self, requests: DataFrame) -> None:
        """Removes the entries of (prompt, model), asked without a system instruction."""
        self.table.replace(invalidated(self.table.read(), requests))

    def clear(self) -> None:
        self.table.replace(self.table.read().limit(0))


def invalidated(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries without those of (prompt, model); the key of a request is made as the cache makes it, without a system instruction."""
    return cache.without_keys(entries, requests.select(cache_key(F.col("prompt"), F.col("model")).alias("key")))
