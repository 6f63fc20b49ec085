"""A log of model calls as a table: runs, per-call rows, running and final figures."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import token_estimate, truncate_for_log, withhold
from millrace.operators.usage import with_cost

LOG = "run_id string, step bigint, model string, provider string, prompt string, response string, input_tokens bigint, output_tokens bigint, latency_ms double, success boolean, error string, metadata string"


def call_log(calls: DataFrame, prices: DataFrame, run: str, order: list[str], keep_prompts: bool = True, keep_responses: bool = True) -> DataFrame:
    """The calls as log rows: step in the run, estimated tokens where none are known, cost, texts cut or withheld."""
    step = F.row_number().over(W.partitionBy(run).orderBy(*order)).cast("bigint")
    fill = lambda count, text: F.coalesce(F.col(count).cast("bigint"), token_estimate(F.col(text)), F.lit(0).cast("bigint"))
    rows = calls.withColumn("step", step).withColumn("input_tokens", fill("input_tokens", "prompt")).withColumn("output_tokens", fill("output_tokens", "response"))
    rows = with_cost(rows, prices, out="cost")
    kept = lambda name, keep: truncate_for_log(withhold(F.col(name), keep)).alias(name)
    return rows.select(F.col(run).alias("run_id"), "step", "model", "provider", kept("prompt", keep_prompts), kept("response", keep_responses), "input_tokens", "output_tokens", F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), "cost", "success", "error")


def run_summary(log: DataFrame) -> DataFrame:
    """(run_id, calls, input_tokens, output_tokens, cost, avg_latency_ms, avg_cost) per run."""
    found = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.sum(F.nanvl("latency_ms", F.lit(0.0))).alias("__ms"))
    return found.select("run_id", "calls", "input_tokens", "output_tokens", "cost", (F.col("__ms") / F.col("calls")).alias("avg_latency_ms"), (F.col("cost") / F.col("calls")).alias("avg_cost"))


class Tracker:
    """Logs the calls of a driver program. A run begins with no figures; leaving it writes its calls and summary as JSON if a folder is given."""

    def __init__(self, spark: SparkSession, prices: DataFrame, folder: str | None = None):
        self.spark, self.prices, self.folder = spark, prices, folder
        self.run_id, self.rows = uuid.uuid4().hex, []

    def __enter__(self) -> Tracker:
        self.run_id, self.rows = uuid.uuid4().hex, []
        return self

    def __exit__(self, kind, *_) -> None:
        if self.folder and self.rows:
            self.log().write.mode("append").json(f"{self.folder}/calls")
            self.summary().write.mode("append").json(f"{self.folder}/runs")

    def add(self, prompt: str, response: str | None, model: str = "unknown", provider: str | None = None, input_tokens: int | None = None, output_tokens: int | None = None, latency_ms: float = 0.0, error: str | None = None, metadata: dict | None = None) -> None:
        self.rows.append((self.run_id, len(self.rows) + 1, model, provider, prompt, response, input_tokens, output_tokens, latency_ms, error is None, error, json.dumps(metadata or {})))

    def log(self) -> DataFrame:
        return call_log(self.spark.createDataFrame(self.rows, LOG), self.prices, "run_id", ["step"])

    def summary(self) -> DataFrame:
        return run_summary(self.log())

    def tracked(self, model: str = "unknown", provider: str | None = None) -> Callable:
        """A decorator for functions from prompt to answer: each call becomes a row, a failed one too, whose error is raised again."""

        def wrap(call: Callable[..., str]) -> Callable[..., str]:
            def run(prompt: str, *args, **kwargs) -> str:
                began = time.perf_counter()
                try:
                    reply = call(prompt, *args, **kwargs)
                except Exception as e:
                    self.add(prompt, None, model, provider, latency_ms=1000 * (time.perf_counter() - began), error=str(e))
                    raise
                self.add(prompt, reply, model, provider, latency_ms=1000 * (time.perf_counter() - began))
                return reply

            return run

        return wrap
