"""Usage, cost and A/B analytics over a log of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import token_estimate

#: USD per 1,000 tokens of a model without a price.
DEFAULT_INPUT, DEFAULT_OUTPUT = 0.001, 0.002
#: List prices per 1,000 tokens (model, input, output).
LIST_PRICES = [
    ("gemini-1.5-pro", 0.00125, 0.005),
    ("gemini-1.5-flash", 0.000075, 0.0003),
    ("gemini-1.0-pro", 0.0005, 0.0015),
    ("gemini-2.0-flash-exp", 0.0001, 0.0004),
    ("claude-sonnet-4-20250514", 0.003, 0.015),
    ("claude-opus-4-20250514", 0.015, 0.075),
    ("claude-3-5-haiku-20241022", 0.0008, 0.004),
]


def list_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIST_PRICES, "model string, input_per_1k double, output_per_1k double")


def with_cost(calls: DataFrame, prices: DataFrame, default_input: float = DEFAULT_INPUT, default_output: float = DEFAULT_OUTPUT, out: str = "cost") -> DataFrame:
    """Adds tokens / 1000 x price; a model without a price takes the defaults (0 for the provider clients' view).

    Prices are a dimension of a row per model; the planner broadcasts it by its size. Missing token counts cost nothing.
    """
    prices = prices.dropDuplicates(["model"]).select(F.col("model").alias("__model"), F.col("input_per_1k").alias("__in"), F.col("output_per_1k").alias("__out"))
    priced = calls.join(prices, F.col("model") == F.col("__model"), "left")
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1000
    cost = tokens("input_tokens") * F.coalesce("__in", F.lit(default_input)) + tokens("output_tokens") * F.coalesce("__out", F.lit(default_output))
    return priced.withColumn(out, cost).drop("__model", "__in", "__out")


def with_estimated_tokens(calls: DataFrame) -> DataFrame:
    """Missing token counts are estimated from the texts."""
    fill = lambda count, text: F.coalesce(F.col(count).cast("bigint"), token_estimate(F.col(text)))
    return calls.withColumn("input_tokens", fill("input_tokens", "prompt")).withColumn("output_tokens", fill("output_tokens", "response"))


def totals(calls: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """calls, input_tokens, output_tokens, cost, latency and mean latency (0 without calls); null and NaN figures count 0."""
    figure = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    count = F.count(F.lit(1))
    latency = F.coalesce(F.sum(figure("latency_ms")), F.lit(0.0))
    return calls.groupBy(*(keys or [])).agg(
        count.alias("calls"),
        F.coalesce(F.sum(F.col("input_tokens").cast("bigint")), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.col("output_tokens").cast("bigint")), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(figure("cost")), F.lit(0.0)).alias("cost"),
        latency.alias("latency_ms"),
        F.coalesce(F.try_divide(latency, count), F.lit(0.0)).alias("avg_latency_ms"),
    )


def by_provider(calls: DataFrame) -> DataFrame:
    """Totals per provider and over all (provider null, is_total true), by rollup."""
    figure = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return calls.rollup("provider").agg(F.grouping("provider").cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens").cast("bigint")).alias("input_tokens"), F.sum(F.col("output_tokens").cast("bigint")).alias("output_tokens"), F.sum(figure("cost")).alias("cost"))


def cumulative(calls: DataFrame, partition: list[str], order: list[str], block: Column | None = None) -> DataFrame:
    """Running totals of tokens and cost per run, a step per call.

    With a `block` (an expression that does not fall along `order`, such as the day of its
    first column) a window covers a block of a run and the totals of earlier blocks come from
    one row per run and block, so a run with very many calls is many tasks. A null run is one.
    """
    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)).cast("bigint") + F.coalesce(F.col("output_tokens"), F.lit(0)).cast("bigint")
    cost = F.coalesce("cost", F.lit(0.0))
    rows = calls.withColumn("__block", block if block is not None else F.lit(0))
    keys = [*partition, "__block"]
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("step", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).withColumn("tokens_so_far", F.sum(tokens).over(frame)).withColumn("cost_so_far", F.sum(cost).over(frame))
    if block is None:
        return rows.drop("__block")
    sums = calls.withColumn("__block", block).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(tokens).alias("__tokens"), F.sum(cost).alias("__cost"))
    earlier = W.partitionBy(*partition).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)], *[F.sum(f"__{x}").over(earlier).alias(f"__{x}") for x in ("n", "tokens", "cost")])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__b{i}"))
    joined = rows.join(before, same, "left")
    for name, x in (("step", "n"), ("tokens_so_far", "tokens"), ("cost_so_far", "cost")):
        joined = joined.withColumn(name, F.col(name) + F.coalesce(f"__{x}", F.lit(0)))
    return joined.drop("__block", "__n", "__tokens", "__cost", *[f"__b{i}" for i in range(len(keys))])


def last_calls(calls: DataFrame, partition: list[str], order: list[Column], k: int = 10) -> DataFrame:
    """The k latest calls per partition (a per-group top-k that is limited before the shuffle)."""
    return calls.withColumn("place", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).filter(F.col("place") <= k)


def ab_summary(runs: DataFrame, variant: str, failed: Column, latency: Column, score: Column) -> DataFrame:
    """Per variant: responses, mean latency, mean score, errors. A failed call counts latency 0 and has no score."""
    return runs.groupBy(F.col(variant).alias("variant")).agg(F.count(F.lit(1)).alias("responses"), F.avg(F.when(failed, F.lit(0.0)).otherwise(latency)).alias("avg_latency"), F.avg(F.when(~failed, score)).alias("avg_score"), F.count_if(failed).alias("errors"))


def cost_estimates(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Seven-field estimate per (row_count, avg_input_tokens, avg_output_tokens, model)."""
    sized = requests.withColumn("total_input_tokens", F.col("row_count") * F.col("avg_input_tokens")).withColumn("total_output_tokens", F.col("row_count") * F.col("avg_output_tokens"))
    prices = prices.dropDuplicates(["model"]).select("model", F.col("input_per_1k").alias("__in"), F.col("output_per_1k").alias("__out"))
    joined = sized.join(prices, "model", "left")
    cost = lambda tokens, price, default: F.col(tokens) / 1000 * F.coalesce(price, F.lit(default))
    joined = joined.withColumn("input_cost", cost("total_input_tokens", "__in", DEFAULT_INPUT)).withColumn("output_cost", cost("total_output_tokens", "__out", DEFAULT_OUTPUT))
    return joined.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).select("row_count", "total_input_tokens", "total_output_tokens", "input_cost", "output_cost", "total_cost", "model")


def usage_windows(calls: DataFrame, user: str, at: Column, ts: str = "ts") -> DataFrame:
    """Calls per user in the last minute, hour and day before `at`."""
    age = F.unix_micros(at) - F.unix_micros(F.col(ts).cast("timestamp"))
    recent = lambda seconds: F.count_if((age >= 0) & (age < seconds * 1_000_000))
    return calls.groupBy(user).agg(recent(60).alias("minute"), recent(3600).alias("hour"), recent(86400).alias("day"))
