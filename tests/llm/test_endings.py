import random

import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import endings as E, pairs as P

ENDS = frozenset({"scheduler", "export", "lookup"})


@pytest.mark.parametrize(
    "text, limit, cut",
    [
        (None, False, False), ("", False, False), ("   ", True, False), ("[not logged]", True, False),
        ("All rows are read. The owner of the tab", False, True), ("All rows are read. The owner asked why.", True, False),
        ("drop duplicates a_b by c_d", False, False), ("a_b schema", False, False), ("a_b sche", True, True),
        ("Which checks should run on a_b before the", False, True), ("Yes, a_b is nullable", False, False), ("about 20 percent", False, False), ("42", False, False), ("Done ✅", False, False),
        ("Reads rows and so on…", False, False), ("Er liest und so weiter…", True, False), ("It reads rows from the sch…", False, True), ("It reads...[truncated]", False, True), ("The note ending in ...[truncated] is fine.", False, False),
        ("```sql\nSELECT 1", False, True), ("```sql\nSELECT 1\n```", True, False),
        ('{"a": 1, "b": [1, 2', False, True), ('{"a": "}"', False, True), ('{"a": "x}"}', True, False), ("[SYSTEM]Use SQL.[/SYSTEM]Find the rows.", False, False),
        ("| a | b |\n|---|---|\n| 1 | 2 |", True, False), ("| a | b |\n|---|---|\n| 1 | 2", False, True), ("| a | b |\n|---|---|\n| 1 |", False, True),
        ("Result:\n- the scheduler\n- the nightly export", False, False), ("Result:\n- the scheduler\n- the night", False, True), ("Result:\n1. the scheduler\n2.", False, True), ("Result:\n- the nightly export", True, True),
        ("Since the last run version 8.", True, True), ("The rows are closed. Run 4835.", True, False), ("Keep the last 12.", True, False), ("He said “all rows are read.”", False, False),
    ],
)
def test_is_cut(text, limit, cut):
    assert E.is_cut(text, limit, ENDS) is cut


def test_copy_without_its_last_mark_is_whole():
    assert not E.is_cut("It rained. Find the rows of the table", False, None, "It rained. Find the rows of the table.")


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_never_crashes(text):
    assert E.is_cut(text, False, ENDS, text) in (True, False)
    assert all(E.encoded_length(text, e) >= 0 for e in E.ENCODINGS)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_lengths_agree(text):
    assert E.encoded_lengths(text) == tuple(E.encoded_length(text, e) for e in E.ENCODINGS)


@pytest.mark.parametrize("encoding, want", [("chars", 6), ("utf8", 10), ("utf16", 7), ("crlf", 7), ("json", 8), ("json_ascii", 24), ("html", 6), ("html_quotes", 11)])
def test_encoded_length(encoding, want):
    assert E.encoded_length('aé"\n🙂b', encoding) == want


SCHEMA = "call_id long, source string, prompt string, response string, field string"


def test_hidden_limit_is_found(spark):
    """A source stores 100 UTF-8 bytes of a response; complete texts of other lengths stay."""
    rng = random.Random(1)
    rows = []
    for k in range(400):
        text = " ".join(rng.choice(["rows", "tables", "über", "the", "lesen"]) for _ in range(rng.randrange(5, 40))).capitalize() + "."
        stored = text.encode()[:100].decode("utf-8", "ignore")
        rows.append((k, "cut" if k % 2 else None, "why", stored if k % 2 else text, "x"))
    rows += [(None, "cut", None, None, "x"), (1, *rows[1][1:]), (9001, "cut", "[not logged]", "", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = E.evidence(df)[0]
    assert ("utf8", 100) in limits["cut", "response"]
    cuts = {r.call_id: r.cut_response for r in E.with_cuts(df).collect()}
    assert len(cuts) == 401 and not any(v for k, v in cuts.items() if k % 2 == 0 or k == 9001)
    assert all(cuts[k] for k in range(1, 400, 2) if len(rows[k][3].encode()) in (99, 100) and not rows[k][3].endswith("."))
    assert E.with_cuts(df.limit(0)).count() == 0


def test_all_limits_are_found(spark):
    """Ten limits of a source, some within 4 % of each other, each once; texts of a shadow length are none."""
    rng, sizes = random.Random(2), (100, 103, 200, 204, 300, 500, 512, 1000, 1024, 2000)
    rows = []
    for n in sizes:
        for k in range(30):
            text = "".join(rng.choice("abcdef gh") for _ in range(n - 3)) + "abc"
            rows.append((len(rows), "s", "why", text if k % 5 else text[1:-3] + "\n-" + "ab", "x"))
    rows += [(len(rows) + k, "s", "why", "b" * (600 + 7 * k), "x") for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = E.evidence(df)[0]["s", "response"]
    assert sorted(n for _, n in limits) == sorted(sizes)
    assert {n for n in sizes} <= {r.length for r in E.hidden_limits(E.text_statistics(df)).collect()}
    assert all(r.cut_response for r in E.with_cuts(df).collect() if r.call_id < 300)


def test_rare_words_of_list_items_are_known(spark, monkeypatch):
    """A word that ends one whole item among many is known, in p1 as in p2; a fragment is not."""
    monkeypatch.setattr(E, "ITEM_WORDS", 10, raising=False)
    rows = [(k, "s", "why", "Result:\n" + "- the export\n" * (k + 5) + "- the export", "x") for k in range(20)] + [(100, "s", "why", "Result:\n- the zebra\n- the export", "x"), (101, "s", "why", "Result:\n- the export\n- the zebra", "x"), (102, "s", "why", "Result:\n- the export\n- the zeb", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.call_id for r in E.with_cuts(df).collect() if r.cut_response} == {102}
    assert {r.call_id for r in P.with_defects(df).collect() if r.defect == "truncated"} == {102}


def test_queries(spark, sf):
    found = E.p2_found(spark, sf)
    assert found.columns == ["call_id", "field"] and found.count() == found.distinct().count() > 0
    shares = E.p2_shares(spark, sf).collect()
    assert sum(r.calls for r in shares) == spark.read.parquet(f"{sf}/llm_calls.parquet").select("call_id").distinct().count()
    assert all(0 <= r.prompt_share <= 1 and 0 <= r.response_share <= 1 for r in shares)
    assert E.p2_limits(spark, sf).columns == ["source", "field", "encoding", "length", "texts", "near"]
