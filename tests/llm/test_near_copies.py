import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_copies as N
from millrace.llm.common import components

WORD = re.compile(r"[^\W_]+")


def shingle_set(text, width):
    words = WORD.findall(text.lower())
    return frozenset(zip(*(words[k:] for k in range(width))))


def brute(rows, t, width, least):
    """All pairs (tbl, a, b) of distinct ids with Jaccard >= t."""
    sets = {(tbl, i): shingle_set(x, width) for tbl, i, x in rows if x is not None and len(WORD.findall(x.lower())) >= max(least, width)}
    keys = sorted(sets)
    return {(p[0], p[1], q[1]) for k, p in enumerate(keys) for q in keys[k + 1 :] if p[0] == q[0] and len(sets[p] & sets[q]) >= t * len(sets[p] | sets[q]) - 1e-12}


def same(rows):
    """Shingle sets that several ids of a table have."""
    seen, twice = set(), set()
    for tbl, i, x in rows:
        if x and len(WORD.findall(x.lower())) >= 30:
            key = tbl, shingle_set(x, 3)
            twice |= {key[1]} if key in seen else set()
            seen.add(key)
    return twice


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"w{rng.randrange(9999)}"
        elif kind == 1:
            words.insert(at, f"w{rng.randrange(9999)}")
        else:
            del words[at]
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    stock = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(60):
        base = [rng.choice(stock) if rng.random() < 0.6 else f"w{rng.randrange(9999)}" for _ in range(rng.randrange(30, 200))]
        for e in range(rng.randrange(1, 5)):
            rows.append(("ab"[k % 2], f"d{k:03d}_{e}", " ".join(edited(rng, base, e * len(base) // 25))))
    hot = "the same long text in a third of all rows " * 6
    rows += [("a", f"h{k:03d}", hot.upper() if k % 2 else hot) for k in range(70)]
    rows += [("a", "long1", " ".join(f"x{k}" for k in range(6000))), ("a", "long2", " ".join(f"x{k}" for k in range(400, 6000)))]
    rows += [("a", "null", None), ("a", "empty", ""), ("b", "short", "too few words"), ("a", "d000_0", rows[0][2])]
    return rows


@pytest.mark.parametrize("t, width, least", [(0.6, 3, 30), (0.8, 5, 5)])
def test_against_brute_force(spark, t, width, least):
    rows = corpus()
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    members, links = N.similar_pairs(df, t, width, least)
    want = brute(set(rows), t, width, least)
    rep = {(m.tbl, m.id): m.rep for m in members.collect()}
    assert rep.keys() == {(tbl, i) for tbl, i, x in rows if x and len(WORD.findall(x.lower())) >= max(least, width)}
    got = {(r.tbl, r.a, r.b) for r in links.collect()}
    between = {(tbl, *sorted((rep[tbl, a], rep[tbl, b]))) for tbl, a, b in want if rep[tbl, a] != rep[tbl, b]}
    assert got == between
    pairs = {(r.tbl, r.id_a, r.id_b) for r in N.expand(members, links).collect()}
    assert pairs <= want
    assert {p for p in want if not p[1].startswith("h")} <= pairs
    assert {("a", "h000", f"h{k:03d}") for k in range(1, 70)} <= pairs


def lists_of(values, table, texts):
    owner, key, hot = N.runs([N.pack(values)], np.array([5], dtype=np.uint64), np.array([texts]), table, N.rates(0.6))
    return set(key.tolist())


@pytest.mark.parametrize("frequent", [1, 20, 1000, 100_000, 800_000])
@pytest.mark.parametrize("common, size", [(60, 100), (120, 200), (1200, 2000), (6000, 10_000)])
def test_similar_sets_meet_at_any_size_and_frequency(common, size, frequent):
    """Of 300 texts and their extensions to similarity 0.6 all but one or two meet twice, however frequent their values are in a corpus of 10**6."""
    rng = np.random.default_rng(3)
    table, missed = np.full(N.COUNTERS, frequent, dtype=np.uint32), 0
    for _ in range(300):
        whole = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(whole[:common]), np.unique(whole)
        missed += len(lists_of(a, table, 10**6) & lists_of(b, table, 10**6)) < 2
    assert missed <= 2


def test_equal_sizes_meet_and_strangers_do_not():
    rng = np.random.default_rng(1)
    table, missed, met = rng.integers(1, 5000, N.COUNTERS).astype(np.uint32), 0, 0
    for _ in range(400):
        pool = rng.integers(0, 2**63, 280, dtype=np.uint64) * np.uint64(2)
        a, b, c = np.unique(pool[:160]), np.unique(pool[40:200]), np.unique(pool[136:280])
        keys = [lists_of(x, table, 10**6) for x in (a, b, c)]
        missed, met = missed + (len(keys[0] & keys[1]) < 2), met + (len(keys[0] & keys[2]) >= 2)
    assert missed <= 2 and met <= 40


def test_few_rare_values_are_enough():
    """Rare values have lists of their own, about a dozen; frequent ones take longer and more runs."""
    values = np.sort(np.random.default_rng(2).integers(0, 2**63, 500, dtype=np.uint64)) * np.uint64(2)
    rare, frequent = (len(lists_of(values, np.full(N.COUNTERS, n, dtype=np.uint32), 10**6)) for n in (5, 5000))
    assert 10 <= rare <= 13 and 40 <= frequent <= N.RETAINED


def test_rates_and_packing():
    assert np.allclose(N.rates(0.6)[1:3], [0.916, 0.316], atol=0.001) and (np.diff(N.rates(0.8)[1:]) < 0).all()
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    assert (N.unpack(N.pack(values)) == values[: N.RETAINED] >> np.uint64(24)).all()


@pytest.mark.parametrize("bound", [4, 12])
def test_hot_lists_become_corpora(spark, monkeypatch, bound):
    """A phrase that most texts share, and one large class of versions: all pairs of a brute force, with lists of a few texts at most."""
    rng = random.Random(9)
    words = lambda n, tag: [f"{tag}{rng.randrange(5000)}" for _ in range(n)]
    phrase, base = words(22, "p"), words(60, "b")
    rows = [("a", f"v{k:03d}", " ".join(edited(rng, base, 2))) for k in range(30)]
    for k in range(40):
        own = words(34, "w")
        rows += [("a", f"f{k:03d}", " ".join(phrase + own)), ("a", f"g{k:03d}", " ".join(edited(rng, phrase + own, 2)))]
    monkeypatch.setattr(N, "LIST_ROWS", bound)
    monkeypatch.setattr(N, "COPIES", 8)
    monkeypatch.setattr(N, "TARGET", 2)
    members, links = N.similar_pairs(spark.createDataFrame(rows, "tbl string, id string, text string"), 0.6, 3, 30)
    assert {(r.tbl, r.id_a, r.id_b) for r in N.expand(members, links).collect()} == brute(rows, 0.6, 3, 30)


def test_lists_are_paired_across_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lists = spark.createDataFrame([(7, k) for k in range(50)] + [(8, 1), (8, 2), (8, 2), (9, 3)], "key long, doc long")
        got = [(r.a, r.b, r.met) for r in N.met_in(lists).groupBy("a", "b").agg(F.sum("met").alias("met")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted((a, b, 2 if (a, b) == (1, 2) else 1) for a in range(50) for b in range(a + 1, 50))


def test_table_of_frequencies(spark):
    sketches = [N.pack(np.array([1 << 40, 2 << 40, k << 41], dtype=np.uint64)) for k in range(5, 25)]
    df = spark.createDataFrame([(3, bytearray(s)) for s in sketches], "salt long, sketch binary").repartition(3)
    table = N.frequencies(df)
    at = N.counter_of(N.unpack(sketches[0]), np.array([3, 3, 3], dtype=np.uint64))
    assert table.sum() == 60 and table[at].tolist() == [20, 20, 1]


def test_estimate():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 1000, dtype=np.uint64)])) for _ in "ab")
    assert abs(N.estimate(a, b) - 0.6) < 0.25
    assert N.estimate(a, a) == 1.0 and N.estimate(a[:10], a[:10]) == 1.0


@pytest.mark.parametrize("copies", [1000, 7])
def test_expand_gives_all_pairs(spark, monkeypatch, copies):
    """Groups of 100, 45 and 1 and their links: every pair of ids, in one list or in several."""
    monkeypatch.setattr(N, "COPIES", copies)
    groups = {"a": [f"a{k:03d}" for k in range(100)], "b": [f"b{k:03d}" for k in range(45)], "c": ["c000"]}
    members = spark.createDataFrame([("t", i, ids[0], len(ids)) for ids in groups.values() for i in ids], "tbl string, id string, rep string, copies long")
    links = spark.createDataFrame([("t", "a000", "b000", 0.7), ("t", "b000", "c000", 0.7)], "tbl string, a string, b string, similarity double")
    got = [(r.id_a, r.id_b) for r in N.expand(members, links).collect()]
    linked = {("a", "a"), ("b", "b"), ("a", "b"), ("b", "c")}
    want = {(x, y) for g, h in linked for x in groups[g] for y in groups[h] if x < y}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("x", "y"), ("z", "y"), ("y", "y")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{k:03d}": "n000" for k in range(41)} | {"x": "x", "y": "x", "z": "x"}


def test_empty(spark):
    df = spark.createDataFrame([], "tbl string, id string, text string")
    members, links = N.similar_pairs(df, 0.8)
    assert members.count() == 0 and links.count() == 0 and N.expand(members, links).count() == 0


def test_queries(spark, sf):
    found = N.p6_found(spark, sf).collect()
    rows = [(r.tbl, r.id, r.text) for r in N.rag_and_cache_texts(spark, sf).distinct().collect()]
    assert {(r.id_a, r.id_b) for r in found} == {(a, b) for _, a, b in brute(rows, 0.6, 3, 30)}
    assert N.p6_groups(spark, sf).count() > 0
    members = N.p6_members(spark, sf).collect()
    assert {r.id for r in members} == {i for _, i, x in rows if x and len(WORD.findall(x.lower())) >= 30}
    assert sum(r.copies > 1 for r in members) == len({x for r in found for x in r if shingle_set(dict((i, t) for _, i, t in rows)[x], 3) in same(rows)})
