import pytest

from scholiast.llm.subjects import Chain, Terms, classify, fit_chain, labels_of, p9_found, sentences_of, terms, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """A sixth of the labelled documents is kept out of the fit; the labels themselves hold some slips."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/subject_labels.parquet")
    held = labels_of(labels).where("pmod(xxhash64(doc_id), 6) = 0")
    chain = fit_chain(docs, labels.where("pmod(xxhash64(doc_id), 6) <> 0"), spark.read.parquet(f"{SF}/subjects.parquet"))
    want = {r.doc_id: set(r.codes) for r in held.collect()}
    got: dict = {}
    for r in classify(docs.join(held.select("doc_id"), "doc_id", "left_semi"), chain).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_code)
    texts = {r.doc_id for r in docs.where("length(trim(text)) > 0").collect()}
    tp = sum(len(want[d] & got.get(d, set())) for d in want if d in texts)
    all_ = sum(len(want[d]) + len(got.get(d, set())) for d in want if d in texts)
    assert len(want) > 150 and 2 * tp / all_ > 0.9


def test_edges(spark, tables):
    assert p9_found(spark, tables()).count() == 0
    chain = train([(k, "The court ruling stands. The statute holds.", "a-b", "section", ["law"]) for k in range(6)] + [(k, "The coral reef grows. The peat bog stays.", None, None, ["ecology"]) for k in range(6, 12)], ["ecology", "law"])
    df = spark.createDataFrame([(1, None, None, None), (2, "", "x", "y"), (3, "  ", "x", "y"), (4, "A court ruling. " * 3000, None, "slide"), (5, "Nothing here.", "x", "y"), (6, "The court ruling. The coral reef.", "x", "y")], "doc_id long, text string, source string, doc_kind string")
    got = {(r.doc_id, r.subject_code) for r in classify(df.selectExpr("*", "1 as share", "'z' as subject_code"), chain).collect()}
    assert {d for d, _ in got} == {4, 6} and (4, "law") in got


def test_labels_are_tidied(spark):
    df = spark.createDataFrame([(1, " Law"), (1, "LAW"), (1, None), (2, ""), (None, "law")], "doc_id long, subject_code string")
    assert [(r.doc_id, r.codes) for r in labels_of(df).collect()] == [(1, ["law"])]


def test_terms_and_sentences():
    assert {"coral reef", "coral"} <= terms("Coral reefs")
    assert {"公共", "公共债务"} <= terms("公共债务")
    assert len(sentences_of("One reef. Two bogs, e.g. here.\n* Three moors")) == 3
    assert sentences_of("") == [] and terms("") == set()


def test_chain_models_cooccurrence():
    import numpy as np

    model = Terms(["a", "b"], {})
    rows = []
    for k in range(200):
        y = np.array([k % 2, k % 2], float)
        own = np.zeros((2, 8))
        own[:, 0] = 0.1
        own[0, :] = 0.5 if k % 2 else 0.1
        rows.append((np.zeros(3), own, y))
    chain = Chain(model).fit(rows, [k % 5 == 0 for k in range(200)])
    assert sorted(chain.decode(*rows[1][:2])[0]) == [0, 1] and chain.decode(*rows[0][:2])[0] == []
    with pytest.raises(IndexError):
        Chain(model).decode(*rows[0][:2])
