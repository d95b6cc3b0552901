"""Queries without SQL, against brute force or hand-made cases."""

import json

from scholiast.operators.reader_scans import consolidate, sentence_boxes
from scholiast.plans.citations import author_year, contrast_sentences
from scholiast.plans.corpus import page_group_binfill, quote_match_fuzzy
from scholiast.plans.evidence import claims_dedup_greedy, click_resolution, semantic_titles
from scholiast.plans.graphs import evidence_closure
from scholiast.plans.pages import definition_lookup, script_json
from scholiast.plans.reader import redacted_props
from tests.test_layout import block

SF = "/root/testdata/sf0.001"
EVIDENCE = "paper_id string, evidence_id string, verbatim_text string, page int, section_id string"
BLOCKS = "paper_id string, page int, ord int, block_id string, text string, role string"


def test_units_against_brute_force(spark):
    got = {(r.paper_id, r.unit): (r.first_page, r.last_page) for r in page_group_binfill(spark, SF).collect()}
    sizes: dict = {}
    for r in spark.read.parquet(f"{SF}/blocks.parquet").where("text is not null").select("paper_id", "page", "block_id", "text").distinct().collect():
        sizes.setdefault(r.paper_id, {}).setdefault(r.page, []).append(len(r.text))
    want = {}
    for paper, pages in sizes.items():
        unit, size, first, last = 0, 0, None, None
        for page in sorted(pages):
            n = sum(pages[page])
            if first is not None and size + n > 2000:
                want[paper, unit] = (first, last)
                unit, size, first = unit + 1, 0, None
            first = page if first is None else first
            size, last = size + n, page
        want[paper, unit] = (first, last)
    assert got == want


def test_author_year(spark, tables):
    cit = [("p", "c1", "[1] Vorlanko, A. (1999). On peat. J. Soil."), ("p", "c2", "[2] Lestrange, B. (2001). On moss. J. Soil."), ("p", "c3", None)]
    rows = [("p", 1, 0, "b0", "It is so (Vorlanko et al., 1999).", "body"), ("p", 1, 1, "b1", "So does Lestrange,", "body"), ("p", 1, 2, "b2", "2001, in short.", "body"), ("p", 1, 3, "b3", "Vorlanko. (x) 1999", "header"), ("p", 1, 4, "b4", None, "body")]
    sf = tables(citations=(cit, "paper_id string, citation_id string, raw_reference string"), blocks=(rows, BLOCKS))
    assert {tuple(r) for r in author_year(spark, sf).collect()} == {("p", "c1", "b0", "direct"), ("p", "c2", "b1", "split")}


def test_contrast(spark, tables):
    rows = [("p", "e1", "They use moss [3]. We instead use peat. It is late.", 1, None), ("p", "e2", "No citation. We instead use peat.", 1, None), ("p", "e3", "Moss [1, 2-4]. It is late.", 1, None), ("p", "e4", None, 1, None)]
    got = {(r.evidence_id, r.context) for r in contrast_sentences(spark, tables(evidence=(rows, EVIDENCE))).collect()}
    assert got == {("e1", "They use moss [3]. We instead use peat."), ("e3", "Moss [1, 2-4].")}


def test_claims(spark, tables):
    long = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn door " * 2
    claims = [("p", "c1", long, ["e1"]), ("p", "c2", long + "x", ["e1"]), ("p", "c3", "another thing", ["e1"]), ("p", "c4", None, ["e1"]), ("p", "c5", "An other thing!", ["e9"])]
    ev = [("p", "e1", "another thingy", 1, "s1")]
    sf = tables(claims=(claims, "paper_id string, claim_id string, summary string, evidence_ids array<string>"), evidence=(ev, EVIDENCE), blocks=([("p", 1, 0, "b0", "zzz", "body"), ("p", 1, 1, "b1", "so another thing is", "body")], BLOCKS))
    assert {r.claim_id for r in claims_dedup_greedy(spark, sf).collect()} == {"c1", "c3"}
    near = {r.claim_id: (r.block_id, r.matched_by) for r in click_resolution(spark, sf).collect()}
    assert near["c3"] == ("b1", "content-match")
    assert {r.claim_id: r.title for r in semantic_titles(spark, sf).collect()}["c3"] == "another thing"
    assert quote_match_fuzzy(spark, sf).count() == 0


def test_definitions(spark, tables):
    rows = [("p", 2, 0, "b0", "d_k = 3", "formula")]
    ev = [("p", "e1", "where d_k is the size of keys", 3, None), ("p", "e2", "where d_k is the size", 9, None), ("p", "e3", "nothing", 2, None)]
    got = [tuple(r) for r in definition_lookup(spark, tables(blocks=(rows, BLOCKS), evidence=(ev, EVIDENCE))).collect()]
    assert got == [("p", "b0", "d_{k}", "e1")]


def test_script_safe(spark, tables):
    text = "a</script>&<b>  "
    got = script_json(spark, tables(evidence=([("p", "e1", text, 1, None)], EVIDENCE))).first().json
    assert "<" not in got and ">" not in got and "&" not in got and json.loads(got) == {"verbatim_text": text}


def test_secrets_are_masked(spark):
    assert all(json.loads(r.props)["api_token"] == "***" for r in redacted_props(spark, SF).limit(5).collect())


def test_reader_rules():
    eq = [block(0, 100, 100, 200, 110, "x = y", "formula"), block(1, 205, 101, 230, 109, "+ z"), block(2, 400, 100, 500, 110, "far"), block(3, 100, 300, 200, 310, "one two three four five = x", "formula")]
    # words below three letters do not count as prose
    assert [(r["joined"], r["n_merged"], r["kind"]) for r in consolidate(eq, 600, 800)] == [("x = y + z", 2, "equation"), ("one two three four five = x", 1, "text")]
    s = sentence_boxes([block(0, 0, 100, 300, 140, "It goes\non here. It\nends.")], 600, 800)
    assert [r["sentence"] for r in s] == ["It goes on here.", "It ends."] and s[1]["y1"] == 140


def test_closure_of_a_long_chain(spark, tables):
    """Evidence sixteen references away is reached, and a cycle ends."""
    chain = [("a", f"o{k}", [f"o{k + 1}" if k < 15 else "e1", *(["o0"] if k == 9 else [])]) for k in range(16)]
    sf = tables(provenance=(chain, "paper_id string, owner_id string, source_ids array<string>"), evidence=([("a", "e1")], "paper_id string, evidence_id string"))
    assert {tuple(r) for r in evidence_closure(spark, sf).select("owner_id", "evidence_id").collect()} == {(f"o{k}", "e1") for k in range(16)}
