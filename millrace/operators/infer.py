"""Model calls as columns: a pluggable batch function, retried, in Arrow batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Infer = Callable[[list[str]], list[str]]


def echo_stub(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: the length of the prompt and 8 hex digits of its SHA-256."""
    return [f"{len(p)}:{hashlib.sha256(p.encode()).hexdigest()[:8]}" for p in prompts]


def _called(infer: Infer, prompts: list[str], retries: int, delay: float) -> list[str]:
    """Answers, or 'Error: ...' for all after `retries` tries with linear back-off (waiting only after a failure)."""
    for attempt in range(1, retries + 1):
        try:
            return infer(prompts)
        except Exception as e:  # noqa: BLE001
            if attempt == retries:
                return [f"Error: {e}"] * len(prompts)
            time.sleep(delay * attempt)
    return []


def infer_udf(infer: Infer = echo_stub, batch: int = 10, retries: int = 3, delay: float = 0.5) -> Callable[[Column], Column]:
    """A pandas UDF around a batch function; null and empty prompts give null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), dtype=object)
        asked = [i for i, p in enumerate(prompts) if p]
        for at in range(0, len(asked), batch):
            part = asked[at : at + batch]
            for i, answer in zip(part, _called(infer, [prompts.iloc[i] for i in part], retries, delay)):
                out.iloc[i] = answer
        return out

    return run


def with_answers(df: DataFrame, prompt: str, out: str = "ai_response", infer: Infer = echo_stub, partitions: int | None = None, **options) -> DataFrame:
    """Adds the answers as a column; works on streams as well. `partitions` bounds the parallel callers, without a counting pass."""
    rows = df.repartition(partitions) if partitions else df
    return rows.withColumn(out, infer_udf(infer, **options)(F.col(prompt)))


def answered_rows(df: DataFrame, prompt: Callable[[pd.DataFrame], pd.Series], out: str = "ai_response", infer: Infer = echo_stub, batch: int = 10, retries: int = 3, delay: float = 0.5) -> DataFrame:
    """Appends the answer to each row, with prompts made from whole rows, in true batches."""
    fields = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, answers = list(prompt(frame)), []
            for at in range(0, len(prompts), batch):
                answers += _called(infer, prompts[at : at + batch], retries, delay)
            yield frame.assign(**{out: answers})

    return df.mapInPandas(run, fields)
