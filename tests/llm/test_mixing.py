import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M


def best_sum(counts, budget):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s, k in product(sums, range(c + 1)) if s + n * k <= budget}
    return max(sums)


@pytest.mark.parametrize("seed", range(40))
def test_knapsack_against_brute_force(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(5)}
    budget = rng.randrange(1, 150)
    taken = M._knapsack(counts, budget)
    assert all(0 < taken[n] <= counts[n] for n in taken)
    assert sum(n * k for n, k in taken.items()) == best_sum(counts, budget)


@pytest.mark.parametrize("seed", range(10))
def test_budget_is_met(seed):
    rng = random.Random(seed)
    counts = {n: rng.randrange(1, 200) for n in rng.sample(range(1, 3000), 400)}
    total = sum(n * c for n, c in counts.items())
    for share in (0.001, 0.3, 0.77, 0.999):
        budget = int(share * total)
        taken = M.fit_budget(counts, budget, seed)
        reached = sum(n * k for n, k in taken.items())
        assert all(taken[n] <= counts[n] for n in taken) and budget - 2 <= reached <= budget
    assert M.fit_budget(counts, total) == counts and M.fit_budget({}, 10) == {} and M.fit_budget({5: 2}, 3) == {}


def test_hot_source_and_length(spark):
    """A third of all documents have one source and length; ranks are salted and the counts still exact."""
    rows = [(k, "hot", 10) for k in range(400)] + [(k, "other", 1 + k % 7) for k in range(400, 1200)] + [(5000, None, 10), (5001, "hot", 0)]
    tokens = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, n_tokens long, copies string")
    targets = [("a", "hot", 1.0, 1, 0.2), ("a", "other", 1.0, 3, 0.2), ("a", "gone", 2.0, 5, 0.2), ("b", "hot", 5.0, 3, 2.0), ("b", "other", None, 1, 2.0)]
    targets = spark.createDataFrame(targets, "mix_id string, source string, weight double, max_repeats int, total_share double")
    old, M.RANKED = M.RANKED, 60
    try:
        plan, total = M.make_plan(tokens, targets)
        drawn = M.draw(tokens, plan).cache()
        got = {(r.mix_id, r.source): (r.n, r.most) for r in drawn.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.max("copies").alias("most")).collect()}
    finally:
        M.RANKED = old
    wanted = {(r["mix_id"], r["source"]): r["budget"] for r in plan}
    assert wanted["a", "gone"] > 0 and ("a", "gone") not in got
    assert abs(got["a", "hot"][0] - wanted["a", "hot"]) < 10 and got["a", "other"][0] == wanted["a", "other"]
    assert got["b", "hot"] == (3 * 4000, 3) and wanted["b", "other"] == 0
    assert drawn.count() == drawn.select("mix_id", "doc_id").distinct().count()


def test_empty(spark):
    tokens = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", "x", 1.0, 1, 0.5)], "mix_id string, source string, weight double, max_repeats int, total_share double")
    plan, total = M.make_plan(tokens, targets)
    assert total == 0 and M.draw(tokens, plan).count() == 0
    assert M.make_plan(tokens, targets.limit(0))[0] == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    shares = M.p8_shares(spark, sf).collect()
    targets = {(r.mix_id, r.source): r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    assert {(r.mix_id, r.source) for r in shares} == targets.keys()
    sizes = {r.source: r.n for r in M.token_table(spark, sf).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    for r in shares:
        can = min(r.wanted_tokens, sizes.get(r.source, 0) * targets[r.mix_id, r.source].max_repeats)
        assert r.reached_tokens <= can and r.reached_tokens >= can - max(5, 0.002 * can)
        assert r.most_copies <= targets[r.mix_id, r.source].max_repeats
