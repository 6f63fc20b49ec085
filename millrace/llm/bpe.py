"""Byte-level BPE of a whole corpus with a public vocabulary (problem 7).

A text is cut by the vocabulary's split pattern; each distinct piece is merged once
per worker and remembered. Merging keeps the ranks of all adjacent pairs in a
segment tree whose root is the leftmost pair of lowest rank, so a piece of n bytes
costs O(n log n) even when it is one run of 40,000 equal letters.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for pure ASCII texts, where `re` is faster; \s there are the five controls 9-13 and space.
SPLIT_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Pieces remembered per worker before the memory starts afresh.
MEMO_PIECES = 500_000
FAR = 1 << 62


def default_ranks_path() -> str:
    """The installed `byte_bpe_50k.tiktoken`, or MILLRACE_BPE_RANKS."""
    named = os.environ.get("MILLRACE_BPE_RANKS")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or default_ranks_path(), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly merge the leftmost adjacent pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [FAR] * (2 * size)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int) -> int:
        """Rank of the pair that starts at part i, and i itself: the smaller wins, then the more left."""
        j = after[i]
        rank = ranks.get(part[i] + part[j]) if j < n else None
        return FAR if rank is None else rank * n + i

    for i in range(n - 1):
        tree[size + i] = key(i)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] != FAR:
        i = tree[1] % n
        j = after[i]
        part[i] += part[j]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        if j < n - 1:
            put(j, FAR)
        put(i, key(i) if i < n - 1 else FAR)
        if before[i] >= 0:
            put(before[i], key(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[part[i]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts; remembers merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.wide, self.narrow = regex.compile(SPLIT), re.compile(SPLIT_ASCII)

        class Memo(dict):
            def __missing__(self, piece: str) -> list[int]:
                if len(self) >= MEMO_PIECES:
                    self.clear()
                ids = self[piece] = merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)
                return ids

        class Lengths(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= MEMO_PIECES:
                    self.clear()
                count = self[piece] = len(merge_piece(piece.encode("utf-8", "surrogatepass"), ranks))
                return count

        self.memo, self.lengths = Memo(), Lengths()

    def pieces(self, text: str) -> list[str]:
        return self.narrow.findall(text) if text.isascii() else self.wide.findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty and a null text give an empty list."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.lengths.__getitem__, self.pieces(text))) if text else 0


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, out_col: str = "ids") -> DataFrame:
    """`id_col` and the token ids of `text_col` as array<int>, one row per input row.

    Narrow (no shuffle): one Arrow pass that reads two columns. The vocabulary (under
    1 MB, fixed) is broadcast once. Null and empty texts give an empty list; marker
    strings are ordinary text; other columns are not read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = df.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [encoder.encode(text) for text in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)), out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, out_col])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {key.dataType.simpleString()}, `{out_col}` array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, ranks_path: str | None = None, out_col: str = "n_tokens") -> DataFrame:
    """The columns `keep` and the token count of `text_col`; null and empty texts count 0."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    keep = keep or []
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            counts = np.fromiter(map(encoder.count, batch.column(batch.num_columns - 1).to_pylist()), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*keep, out_col])

    return df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, f"{fields}{', ' if keep else ''}`{out_col}` bigint")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
