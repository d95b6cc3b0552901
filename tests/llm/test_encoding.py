import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholiast.llm.encoding import encoder, joined_pairs, load_ranks, p7_ids, with_ids, with_token_count

VOCABULARY = "/opt/tokenizers/byte_bpe_50k"


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY + ".json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    from tokenizers import Tokenizer

    global T  # noqa: PLW0603 - one tokenizer for all examples
    T = globals().get("T") or Tokenizer.from_file(VOCABULARY + ".json")
    T.encode_special_tokens = True
    assert encoder()(text).tolist() == T.encode(text, add_special_tokens=False).ids


def test_spaces_and_marks(direct):
    r = random.Random(3)
    for _ in range(500):
        s = "".join(r.choices(["a", "bc", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "1", "'s", "'", "<|endoftext|>", "é", "字", "!", "…"], k=15))
        assert encoder()(s).tolist() == direct(s), repr(s)


def test_forced_cuts_are_certain():
    ranks = load_ranks(VOCABULARY + ".tiktoken")
    joined = joined_pairs(ranks)
    assert all(joined[a, b] for t in list(ranks)[::97] for a, b in zip(t, t[1:]))
    assert not joined.all()


def test_corpus_and_edges(spark, direct, tables):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in p7_ids(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == rows.keys()
    assert all(got[k] == (direct(v) if v else []) for k, v in rows.items())
    assert p7_ids(spark, tables()).count() == 0
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (None, "a b", 5), (4, "word " * 50000, 5)], "doc_id long, text string, ids int")
    out = {r.doc_id: r.ids for r in with_ids(df, "text", ["doc_id"]).collect()}
    assert out[1] == [] and out[2] == [] and out[3] == direct(" ") and out[None] == direct("a b") and len(out[4]) == 50001
    assert {r.doc_id: r.n_tokens for r in with_token_count(df, "text", ["doc_id"]).collect()}[4] == 50001
