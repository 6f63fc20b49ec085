import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import spans as S


def longest_run(a, b, least):
    """Whether some `least` characters of a are in b."""
    return any(a[k : k + least] in b for k in range(len(a) - least + 1))


def made(seed=2, docs=60):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é🙂\n") for _ in range(n))
    passages = [text(rng.randrange(150, 420)) for _ in range(8)]
    rows = []
    for k in range(docs):
        body = text(rng.randrange(50, 600))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(60)
            body += p[a : len(p) - rng.randrange(60)] + text(rng.randrange(30))
        rows.append((k, body))
    return rows


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_common_run_keeps_a_common_hash(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    run = text(200)
    kept = [set(S.winnowed([text(rng.randrange(300)) + run + text(rng.randrange(300))])[2].tolist()) for _ in "xy"]
    assert kept[0] & kept[1]


def test_hash_depends_on_the_piece_only():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**20, 500, dtype=np.uint32)
    assert (S.gram_hashes(codes, 64)[100:200] == S.gram_hashes(codes[100:263], 64)).all() and S.gram(200) == 128


def cover(doc, others, least):
    """Disjoint stretches of doc whose runs of `least` are in others."""
    out = []
    for k in range(len(doc) - least + 1):
        if any(doc[k : k + least] in o for o in others):
            if out and k <= out[-1][1]:
                out[-1] = (out[-1][0], k + least)
            else:
                out.append((k, k + least))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_shard_automaton_against_brute_force(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    refs = [word(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))]
    bits: dict = {}
    for k, r in enumerate(refs):
        bits[r] = bits.get(r, 0) | 1 << k
    text, got = word(40), {}
    for at, size, seen in S.ShardAutomaton(bits, 4).statistics(text):
        got[at] = size, seen
    want = {}
    for at in range(1, 41):
        size = max(n for n in range(at + 1) if any(text[at - n : at] in r for r in refs))
        if size >= 4:
            want[at] = size, sum(1 << k for k, r in enumerate(refs) if text[at - 4 : at] in r)
    assert got == want


def test_pairs_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc long, text string")
    got = {(r.a, r.b) for r in S.sharing_pairs(df).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and longest_run(x, y, 200)}
    assert got == want and want


def test_spans_shares_and_rest_against_brute_force(spark):
    rows = made(5, 30) + [(100, "xy" * 700), (101, "yx" * 300), (102, None), (103, ""), (104, "z" * 199)]
    rows += [(200, rows[0][1] * 2)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc long, text string, start string")
    spans = S.shared_spans(df)
    got: dict = {}
    for r in spans.collect():
        got.setdefault(r.doc, []).append((r.start, r.end))
    want = {d: c for d, t in rows if t and (c := cover(t, [o for e, o in rows if e != d and o], 200))}
    assert {d: sorted(v) for d, v in got.items()} == want
    shares = {r.doc: (r.n_chars, r.shared_chars) for r in S.shared_shares(df, spans).collect()}
    texts = dict(rows)
    assert shares == {d: (len(texts[d]), sum(b - a for a, b in c)) for d, c in want.items()}
    rest = {r.doc: r.text for r in S.without_spans(df, spans).collect()}
    marked = {d: "".join(c for k, c in enumerate(texts[d]) if not any(a <= k < b for a, b in v)) for d, v in want.items()}
    assert rest == marked


@pytest.mark.parametrize("meet, shard, streams", [(8, 32_000, 10_000), (1000, 900, 7), (8, 900, 7)])
def test_hot_passage_and_hot_boilerplate(spark, monkeypatch, meet, shard, streams):
    """Pairs and spans of a hot passage, and those whose run is only routed by a hot piece, against brute force: in one shard, in many, by windows."""
    for name, value in (("MEET", meet), ("SHARD", shard), ("STREAMS", streams), ("PIECE", 300)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    hot, piece = text(260), text(150)
    twins = [text(40) + piece + text(40) for _ in range(5)]
    rows = [(k, hot + text(50)) for k in range(20)] + [(k, text(90) + piece + text(90)) for k in range(20, 50)]
    rows += [(k, text(30) + twins[k % 5] + text(80)) for k in range(50, 65)] + [(70, hot + text(300) + twins[0]), (71, twins[0] + hot + twins[0])]
    df = spark.createDataFrame(rows, "doc long, text string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and longest_run(x, y, 200)}
    assert {(r.a, r.b) for r in S.sharing_pairs(df).collect()} == want and len(want) > 200
    got: dict = {}
    for r in S.shared_spans(df).collect():
        got.setdefault(r.doc, []).append((r.start, r.end))
    assert {d: sorted(v) for d, v in got.items()} == {d: c for d, t in rows if (c := cover(t, [o for e, o in rows if e != d], 200))}


def test_footer_of_over_a_thousand_documents(spark):
    """1,050 documents with one footer of 150 characters, 100 pairs of which share 204 characters around it: all are found."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    footer, rows = text(150), []
    for k in range(1050):
        near = text(54)
        if k < 200 and k % 2:
            near = rows[-1][1][-204:-150]
        rows.append((k, text(200) + near + footer))
    df = spark.createDataFrame(rows, "doc long, text string")
    assert {(r.a, r.b) for r in S.sharing_pairs(df).collect()} == {(k, k + 1) for k in range(0, 200, 2)}


@pytest.mark.parametrize("query, size", [("p9_found", 66), ("p9_shares", 12), ("p9_removed", 12)])
def test_queries_find_all_of_a_hot_passage(spark, tmp_path, monkeypatch, query, size):
    monkeypatch.setattr(S, "MEET", 4)
    rng = random.Random(6)
    hot = "".join(rng.choice("abcdef") for _ in range(230))
    spark.createDataFrame([(k, hot + chr(0x4E00 + k)) for k in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert S.QUERIES[query](spark, str(tmp_path)).count() == size


def test_long_documents(spark):
    """A passage deep in texts of 300,000 characters, and a text of one letter."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = text(5000)
    rows = [(1, text(150_000) + passage + text(150_000)), (2, text(10) + passage), (3, "z" * 100_000), (4, "z" * 300), (5, text(300_000))]
    df = spark.createDataFrame(rows, "doc long, text string")
    assert {(r.a, r.b) for r in S.sharing_pairs(df).collect()} == {(1, 2), (3, 4)}
    spans = {r.doc: (r.start, r.end) for r in S.shared_spans(df).collect()}
    assert spans == {1: (150_000, 155_000), 2: (10, 5010), 3: (0, 100_000), 4: (0, 300)}


def test_empty_table_and_queries(spark, sf):
    df = spark.createDataFrame([], "doc long, text string")
    assert S.shared_spans(df).count() == 0 and S.sharing_pairs(df).count() == 0 and S.without_spans(df, S.shared_spans(df)).count() == 0
    texts = {r.doc: r.text for r in S.corpus(spark, sf).collect() if r.text}
    want = {(a, b) for a in texts for b in texts if a < b and longest_run(texts[a], texts[b], 200)}
    assert {(r.doc_id_a, r.doc_id_b) for r in S.p9_found(spark, sf).collect()} == want
    assert {r.doc_id for r in S.p9_shares(spark, sf).collect()} == {x for p in want for x in p}
