"""Registry queries on hand-made cases; their SQL is checked by the parity tests."""

from pyspark.sql import functions as F

from scholiast.operators.ordering import numbered
from scholiast.plans import registry as R


def test_paths_and_links(spark, tables):
    rows = [("a", "x/y.pdf", "https://h.example/x"), ("b", "../y.pdf", "http://localhost:80/"), ("c", "x/../../y", "ftp://h.example"), ("d", "/y", None), ("e", "x/../y", "https://h"), ("f", None, "")]
    sf = tables(papers=(rows, "paper_id string, local_pdf string, original_url string"))
    assert {r.paper_id: r.confined for r in R.path_gate(spark, sf).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": True}
    got = {r.paper_id: (r.is_web, r.has_host, r.is_endpoint) for r in R.link_checks(spark, sf).collect()}
    assert got == {"a": (True, True, True), "b": (False, True, True), "c": (False, False, False), "e": (False, True, True), "f": (False, False, False)}


def test_kinds_of_sources(spark, tables):
    prov = [("a", "p1", "claim:1", [" Evidence:1", "block:1", None, "", "gone"]), ("a", "p2", "evidence:1", ["block:1"]), ("a", "p3", None, ["block:1"]), ("a", "p4", "claim:1", None)]
    sf = tables(
        provenance=(prov, "paper_id string, provenance_id string, owner_id string, source_ids array<string>"), claims=([("a", "claim:1")], "paper_id string, claim_id string"),
        evidence=([("a", "evidence:1")], "paper_id string, evidence_id string"), blocks=([("a", "block:1"), ("a", None)], "paper_id string, block_id string"),
    )
    assert {tuple(r) for r in R.source_kind_gate(spark, sf).collect()} == {("a", "p1", "claim", "block:1", "block")}
    assert {(r.owner_id, r.source_id, r.pos) for r in R.source_union(spark, sf).collect()} == {("claim:1", "evidence:1", 0), ("claim:1", "block:1", 1), ("claim:1", "gone", 4), ("evidence:1", "block:1", 0)}
    assert R.entity_index(spark, sf).count() == 3


def test_ranks_of_a_group_that_spans_ranges(spark):
    rows = [("hot", k) for k in range(500)] + [("cold", k) for k in range(3)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, k int").orderBy(F.rand(1))
    got = {(r.g, r.k): r.rank for r in numbered(df, ["g"], [F.col("k")], "rank").collect()}
    assert got == {(g, k): k for g, k in rows if g}
    assert numbered(df.limit(0), ["g"], [F.col("k")], "rank").count() == 0
