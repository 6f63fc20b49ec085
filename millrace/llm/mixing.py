"""Mixing sources to target weights by subset-sum budget fitting (problem 8).

A source's budget is its share of the mix in tokens. As many whole passes over the source
as fit go in first; of the rest, documents are counted by exact token length, most of the
budget is filled in proportion to those counts, and a bounded-knapsack dynamic program over
the counts left picks lengths whose sum comes nearest to what remains. Which documents of
a length are taken is decided by a seeded hash of their id.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import count_tokens
from millrace.llm.common import write_once
from millrace.session import load

SEED = 17
#: Budget left to the dynamic program, as a multiple of the source's longest common length, and its bounds in tokens.
TAIL_LENGTHS, TAIL_LEAST, TAIL_MOST = 4, 256, 60_000
#: Documents of one source and length that one task ranks; more are salted.
RANKED = 50_000


def fit_budget(counts: dict[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """How many documents of each length to take, at most counts[length], so that the sum is as near below `budget` as can be.

    Lengths of 0 are left out. When everything fits, everything is taken.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0 and n <= budget}
    total = sum(n * c for n, c in counts.items())
    if total <= budget:
        return counts
    rng = random.Random(seed)
    tail = min(TAIL_MOST, max(TAIL_LEAST, TAIL_LENGTHS * _common_length(counts)), budget)
    share = (budget - tail) / total
    taken: Counter = Counter()
    left = budget
    for n in sorted(counts):
        want = share * counts[n]
        k = min(counts[n], int(want) + (rng.random() < want - int(want)), left // n)
        if k:
            taken[n] += k
            left -= n * k
    # What the roundings left beyond the tail goes to the most numerous lengths first.
    for n in sorted(counts, key=lambda n: (-counts[n], n)):
        if left <= TAIL_MOST:
            break
        k = min(counts[n] - taken[n], (left - tail) // n)
        if k > 0:
            taken[n] += k
            left -= n * k
    taken.update(_knapsack({n: counts[n] - taken[n] for n in counts if n <= left}, left))
    return {n: k for n, k in taken.items() if k}


def _common_length(counts: dict[int, int]) -> int:
    """The length that 90 % of the documents do not exceed."""
    total, seen = sum(counts.values()), 0
    for n in sorted(counts):
        seen += counts[n]
        if seen >= 0.9 * total:
            return n
    return 0


def _knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded subset sum: the largest reachable sum up to `budget`, as counts per length.

    Reachable sums are the bits of one integer; a length's copies go in as binary bundles,
    and the bundles of the best sum are read back from the stored integers.
    """
    mask = (1 << (budget + 1)) - 1
    bundles, states = [], [1]
    for n in sorted(counts, reverse=True):
        left, size = min(counts[n], budget // n), 1
        while left > 0:
            k = min(size, left)
            state = (states[-1] | states[-1] << (n * k)) & mask
            if state != states[-1]:
                bundles.append((n, k))
                states.append(state)
            left -= k
            size *= 2
        if states[-1] >> budget & 1:
            break
    at, taken = states[-1].bit_length() - 1, Counter()
    for (n, k), before in zip(reversed(bundles), reversed(states[:-1])):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken


def plan(histogram: list[tuple[str, int, int]], targets: list[tuple[str, str, float, int, float]], total: int, seed: int = SEED) -> list[dict]:
    """One row per mix and source: budget, whole passes and the counts per length of the partial pass.

    `histogram` has (source, tokens, documents), `targets` (mix_id, source, weight, max_repeats,
    total_share). Weights count relative to the sum in their mix; null, NaN and negative
    weights count 0, max_repeats below 1 or null takes nothing. A source without documents
    keeps its budget and gets nothing.
    """
    by_source: dict[str, dict[int, int]] = {}
    for source, n, docs in histogram:
        by_source.setdefault(source, {})[n] = docs
    weight = lambda w: w if w is not None and w == w and 0 < w < float("inf") else 0.0
    sums: Counter = Counter()
    for mix, _, w, _, _ in targets:
        sums[mix] += weight(w)
    rows = []
    for mix, source, w, repeats, part in sorted(targets, key=lambda r: (r[0], r[1] or "")):
        budget = round(weight(w) / sums[mix] * (part or 0) * total) if sums[mix] else 0
        counts = by_source.get(source, {})
        size = sum(n * c for n, c in counts.items())
        repeats = max(0, repeats or 0)
        passes = min(repeats, budget // size) if size else 0
        rest = budget - passes * size
        partial = fit_budget(counts, rest, seed) if size and passes < repeats else {}
        rows.append({"mix_id": mix, "source": source, "weight": weight(w) / sums[mix] if sums[mix] else 0.0, "budget": budget, "passes": passes, "partial": partial})
    return rows


def token_table(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, in byte_bpe_50k tokens; written once, as it is read for counts and for the draw."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return write_once(count_tokens(docs, "text", ["doc_id", "source"], ranks_path))


def make_plan(tokens: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[list[dict], int]:
    """The plan and the total of tokens. The driver gets one row per source and distinct token length of the sources named in a target."""
    wanted = targets.select("mix_id", "source", F.col("weight").cast("double"), F.col("max_repeats").cast("int"), F.col("total_share").cast("double"))
    wanted = [tuple(r) for r in wanted.filter("mix_id is not null").dropDuplicates(["mix_id", "source"]).collect()]
    histogram = tokens.filter(F.col("source").isin([r[1] for r in wanted if r[1] is not None])).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")).collect()
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    return plan([(r.source, r.n_tokens, r.docs) for r in histogram], wanted, total, seed), total


def draw(tokens: DataFrame, rows: list[dict], seed: int = SEED) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies): how often each document goes into each mix.

    Documents of a source and length are ranked by the seeded hash of their id; a pair with
    over RANKED documents is ranked in salted parts whose sizes are known from counts, so no
    task holds a whole hot source or length.
    """
    spark = tokens.sparkSession
    passes = [(r["mix_id"], r["source"], r["passes"]) for r in rows]
    partial = [(r["mix_id"], r["source"], n, k) for r in rows for n, k in r["partial"].items()]
    whole = spark.createDataFrame(passes, "mix_id string, source string, passes int")
    some = spark.createDataFrame(partial, "mix_id string, source string, n_tokens bigint, take bigint")
    hashed = tokens.filter("source is not null and doc_id is not null and n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    groups = hashed.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    salted = hashed.join(groups.filter(F.col("docs") > RANKED).withColumn("salts", F.ceil(F.col("docs") / RANKED)), ["source", "n_tokens"], "left")
    # Ranges of the hash are the salts, so ranks follow the hash over all parts.
    part = F.floor((F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))) * F.coalesce("salts", F.lit(1))).cast("int")
    salted = salted.withColumn("part", part).select("doc_id", "source", "n_tokens", "h", "part")
    sizes = salted.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("docs"))
    before = F.coalesce(F.sum("docs").over(W.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).filter("before > 0").select("source", "n_tokens", "part", "before")
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("source", "n_tokens", "part").orderBy("h", "doc_id")))
    ranked = ranked.join(sizes, ["source", "n_tokens", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    drawn = ranked.join(whole, "source").join(some, ["mix_id", "source", "n_tokens"], "left")
    copies = F.col("passes") + F.when(F.col("rank") <= F.col("take"), 1).otherwise(0)
    return drawn.withColumn("copies", copies.cast("int")).filter("copies > 0").select("mix_id", "source", "doc_id", "n_tokens", "copies")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix, and how often."""
    tokens = token_table(spark, sf_dir)
    rows, _ = make_plan(tokens, load(spark, sf_dir, "mix_targets"))
    return draw(tokens, rows)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source: wanted share and tokens, reached tokens, share of the mix and of all drawn documents."""
    tokens = token_table(spark, sf_dir)
    rows, total = make_plan(tokens, load(spark, sf_dir, "mix_targets"))
    drawn = draw(tokens, rows).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("documents"), F.max("copies").alias("most_copies"))
    wanted = spark.createDataFrame([(r["mix_id"], r["source"], r["weight"], r["budget"]) for r in rows], "mix_id string, source string, wanted_share double, wanted_tokens bigint")
    shares = wanted.join(drawn, ["mix_id", "source"], "left").fillna(0, ["reached_tokens", "documents", "most_copies"])
    mix = W.partitionBy("mix_id")
    return shares.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", F.sum("reached_tokens").over(mix)), F.lit(0.0))).withColumn("reached_of_wanted", F.coalesce(F.try_divide("reached_tokens", F.col("wanted_tokens")), F.lit(0.0)))


def p8_met(spark: SparkSession, sf_dir: str, slack: int = 16) -> DataFrame:
    """(mix_id, source, docs, met) per target: the documents of the source, and whether the budget was met.

    Met: the drawn tokens are at most the budget and within `slack` of the smaller of the
    budget and what max_repeats allows, or every document that still fits was drawn; no
    document was drawn more often than allowed.
    """
    tokens = token_table(spark, sf_dir)
    targets = load(spark, sf_dir, "mix_targets")
    rows, _ = make_plan(tokens, targets)
    drawn = draw(tokens, rows).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most"))
    sizes = tokens.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("docs"), F.min(F.when(F.col("n_tokens") > 0, F.col("n_tokens"))).alias("shortest"))
    wanted = spark.createDataFrame([(r["mix_id"], r["source"], r["budget"]) for r in rows], "mix_id string, source string, budget bigint")
    repeats = targets.select("mix_id", "source", F.coalesce("max_repeats", F.lit(0)).alias("repeats")).dropDuplicates(["mix_id", "source"])
    joined = wanted.join(repeats, ["mix_id", "source"]).join(sizes, "source", "left").join(drawn, ["mix_id", "source"], "left").fillna(0, ["reached", "most", "size", "docs", "shortest"])
    goal = F.least("budget", F.greatest(F.col("repeats"), F.lit(0)) * F.col("size"))
    met = (F.col("reached") <= F.col("budget")) & (F.col("most") <= F.greatest("repeats", F.lit(0))) & (F.col("reached") >= goal - F.greatest(F.lit(slack), F.col("shortest")))
    return joined.select("mix_id", "source", "docs", met.alias("met"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_met": p8_met}

#: The targets and the documents of their sources; that all budgets are met is what the operator promises.
ORACLES = {"p8_met": "SELECT DISTINCT m.mix_id, m.source, coalesce(d.docs, 0) AS docs, true AS met FROM mix_targets m LEFT JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY 1) d ON m.source = d.source WHERE m.mix_id IS NOT NULL"}
