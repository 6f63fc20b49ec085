import pytest

tiktoken = pytest.importorskip("tiktoken")
from hypothesis import given, settings, strategies as st  # noqa: E402

from millrace.llm import bpe  # noqa: E402

RANKS = bpe.read_ranks()
ENCODER = bpe.Encoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=RANKS, special_tokens={})

CASES = ["", " ", "\n\n  x", "it's we'll 12½ a_b", "<|endoftext|>", "naïve 你好 🙂🙂", "\x1c\x1d a", "a" * 3000, " 　 x", "x" * 999 + " " * 999, "ﬀ ⅷ ²", "'S 't"]


@pytest.mark.parametrize("text", CASES)
def test_same_as_public_library(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)
    assert ENCODER.count(text) == len(ENCODER.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127)))
def test_ascii_split_equals_wide_split(text):
    assert ENCODER.narrow.findall(text) == ENCODER.wide.findall(text)


def test_long_piece_is_quick():
    text = "ab" * 20_000
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_corpus(spark, sf):
    got = {r.doc_id: r.ids for r in bpe.p7_ids(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == (REFERENCE.encode_ordinary(t) if t else []) for k, t in texts.items())


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi", 7), (3, "hi", 7)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect())
    assert rows == [(1, []), (2, []), (3, REFERENCE.encode_ordinary("hi")), (3, REFERENCE.encode_ordinary("hi"))]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert [r.n_tokens for r in bpe.count_tokens(df, keep=["doc_id"]).orderBy("doc_id").collect()][:2] == [0, 0]
