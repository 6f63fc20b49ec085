import json
import random
import re

import pytest

from millrace.llm import format_copies as C


def same(a, b):
    return C.canonical(a, "k", "m") == C.canonical(b, "k", "m")


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("Find the rows.", "find   THE\trows", True),
        ("erkläre bitte, was", "ERKLÄRE BITTE WAS", True),
        ("schließt", "SCHLIESST", True),
        ("café", "café", True),
        ("at 08:04, go", "at 0804 go", True),
        ("find 1", "find 2", False),
        ('{"a": 1, "b": "x y"}', '{"B" : "x-y", "A": "1"}', True),
        ('{"a": 1, "b": 2}', '{"a": 2, "b": 1}', False),
        ('{"a": "bc", "d": 1}', '{"ab": "c", "d": 1}', False),
        ("table: t_1\ntask: mask", "TASK:mask | TABLE:T-1", True),
        ("table: t_1\ntask: mask", "table: mask\ntask: t_1", False),
        ("a: x; b: y", '{"b": "y", "a": "x"}', True),
        ("(table: t\ndays: 3)", "days: 3\ntable: t", True),
        ("Wichtig für claims: der Lauf", "wichtig für claims der lauf", True),
        ('{"a": {"x": 1, "y": 2}}', '{"a": {"y": 2, "x": 1}}', True),
        ('{"a": [1, 2], "b": 0}', '{"a": [2, 1], "b": 0}', False),
        ("", " .,", True),
    ],
)
def test_canonical(a, b, equal):
    assert same(a, b) is equal


def test_model_null_and_withheld():
    assert C.canonical("x", "k", None) != C.canonical("x", "k", "m")
    assert C.canonical("[not logged]", "AB-1", "m") == C.canonical("[not logged]", "ab1", "m")
    assert C.canonical("[not logged]", "ab1", "m") != C.canonical("ab1", "zz", "m")
    assert C.canonical(None, "k", "m") != C.canonical("", "k", "m")


def test_trie_counts_like_a_dictionary():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))) for _ in range(500)]
    want: dict = {}
    for w in words:
        want[w] = want.get(w, 0) + 1
    got = C.counted([(b"#" + w, w) for w in words], [(b"#" + w, f"x{k:03d}", 1) for k, w in enumerate(words)])
    assert {d[1:]: n for d, _, n in got} == want and {d[1:]: i for d, i, _ in got} == {w: f"x{words.index(w):03d}" for w in want}


def test_one_digest_of_two_forms_is_noticed():
    with pytest.raises(ValueError):
        C.counted([(b"#", b"a"), (b"#", b"b")], [])


def test_long_field_names_are_fields():
    name = "the name of a field that goes on " * 20
    assert same(f"{name}: 1\nb: 2", f"B: 2; {name.upper()}:1") and not same(f"{name}: 1\nb: 2", f"{name}: 2\nb: 1")
    assert not same("a" + " " * 100_000 + "\nb: 2", "b: 2\na")


SCHEMA = "entry_id string, prompt string, key string, model string, form int"


def test_hot_group_small_buckets_and_dirt(spark):
    """A third of all rows are one group; buckets split; null ids stay out; repeated ids count once."""
    rows = [(f"h{i:04d}", "Hot  prompt" if i % 2 else "hot prompt!", "k", "m", 1) for i in range(300)]
    rows += [(f"u{i:04d}", f"prompt number {i}", "k", None, 1) for i in range(600)]
    rows += [(None, "hot prompt", "k", "m", 1), ("h0003", "Hot  prompt", "k", "m", 1), ("e1", None, None, None, 1), ("e2", "x" * 5000, "k", "m", 1), ("e3", "X" * 5000 + ".", "k", "m", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    canon = C.canonical_rows(df, "entry_id", "prompt", "key", "model").cache()
    old, C.GROUP_ROWS = C.GROUP_ROWS, 40
    try:
        members, counts = C.count_copies(canon, rows=2)
        pairs = {(r.id, r.first_id, r.copies) for r in C.attach(members, counts).collect()}
    finally:
        C.GROUP_ROWS = old
    assert pairs == {(f"h{i:04d}", "h0000", 300) for i in range(300)} | {("e2", "e2", 2), ("e3", "e2", 2)}
    assert counts.count() == 603 and members.count() == 903
    empty = C.canonical_rows(df.limit(0), "entry_id", "prompt", "key", "model").cache()
    assert C.count_copies(empty)[1].count() == 0


def test_only_large_buckets_are_split(spark):
    """Buckets are leading canonical bytes; those that hold too many forms, or bytes, are split until they fit or are one form."""
    texts = [f"the same beginning of many prompts {k:04d}" for k in range(200)] + [f"{k:08d} other" for k in range(50)] + ["x" * 3000, "x" * 3001]
    df = spark.createDataFrame([(f"e{k:04d}", t, None, "m", 1) for k, t in enumerate(texts)], SCHEMA)
    canon = C.canonical_rows(df, "entry_id", "prompt", "key", "model").cache()
    heavy = C.radix_prefixes(canon, rows=20)
    long = b"thesamebeginningofmanyprompts"
    assert {long[:8], long[:16]} <= heavy and all(p.startswith(long[:8]) for p in heavy)
    sizes: dict = {}
    for t in texts:
        at = C.bucket(C.canonical(t, None, "m"), heavy)
        sizes[at] = sizes.get(at, 0) + 1
    assert max(sizes.values()) <= 20 and C.bucket(b"ab", heavy) != C.bucket(b"abc", heavy)
    assert b"x" * 2048 in C.radix_prefixes(canon, rows=20, size=5000)


def test_query_against_brute_force(spark, sf):
    entries = spark.read.parquet(f"{sf}/cache_entries.parquet").dropDuplicates(["entry_id"]).collect()
    groups: dict = {}
    for e in entries:
        groups.setdefault(C.canonical(e.prompt, e.key, e.model), []).append(e.entry_id)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {(r.id_a, r.id_b) for r in C.p5_found(spark, sf).collect()} == want
    assert sum(r.copies for r in C.p5_requests(spark, sf).collect()) == len(entries)
