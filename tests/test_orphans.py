import datetime as dt
import random

from pyspark.sql import functions as F

from scholiast import catalog
from scholiast.operators.orphans import merge_counts, orphan_keys, p4_found

T = [dt.datetime(2024, 1, d) for d in range(1, 29)]


def tables_of(spark, tables, seed):
    r = random.Random(seed)
    ids = [f"evidence:{k}" for k in range(6)]
    ev, cl, pv = [], [], []
    for p in ("a", "b"):
        for i in r.sample(ids, 4):
            came = r.choice(T)
            gone = r.choice([None, None, r.choice(T)])
            ev += [(p, i, came, gone)] + [(p, i, r.choice(T), gone)] * r.randint(0, 1)
        for k in range(4):
            named = [r.choice([*ids, " Evidence:1 ", "", " ", None]) for _ in range(r.randint(0, 4))]
            cl += [(p, f"claim:{k}", named, r.choice(T))] * r.randint(1, 2)
        for k in range(3):
            pv.append((p, f"prov:{k}", [r.choice([*ids, "claim:1", "record:1", "record:9", "block:1"]) for _ in range(3)], r.choice(T)))
    pv.append((None, None, None, None))
    md = [("record:1", T[5], T[15])]
    return tables(
        evidence=(ev, "paper_id string, evidence_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
        claims=(cl, "paper_id string, claim_id string, evidence_ids array<string>, ingested_at timestamp_ntz"),
        provenance=(pv, "paper_id string, provenance_id string, source_ids array<string>, ingested_at timestamp_ntz"),
        metadata=(md, "record_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
    ), ev, cl, pv, md


def brute(ev, cl, pv, md):
    def alive(rows, at):
        return any(min(x[0] for x in rows) <= at and not (g and g <= at) for _, g in rows)

    def by(rows):
        out = {}
        for *k, came, gone in rows:
            out.setdefault(tuple(k), []).append((came, gone))
        return out

    e, m = by(ev), by(md)
    c = {}
    for p, i, _, at in cl:
        c.setdefault((p, i), []).append((at, None))
    found = set()
    for field, rows in (("claims.evidence_ids", cl), ("provenance.source_ids", pv)):
        first = {}
        for p, o, ids, at in rows:
            for i in ids or []:
                i = (i or "").strip().lower()
                if i:
                    k = (p, o, i)
                    first[k] = min(first.get(k, at), at)
        for (p, o, i), at in first.items():
            named = [e.get((p, i))]
            if field != "claims.evidence_ids":
                named += [c.get((p, i)), m.get((i,))]
            if not any(n and alive(n, at) for n in named):
                found.add((field, p, o, i))
    return found


def test_against_brute_force(spark, tables):
    for seed in range(4):
        sf, *rows = tables_of(spark, tables, seed)
        assert {tuple(r) for r in p4_found(spark, sf).collect()} == brute(*rows), seed


def test_empty(spark, tables):
    assert p4_found(spark, tables()).count() == 0


def test_counts_do_not_depend_on_batches(spark):
    rows = [("k", 1, 0), ("k", 0, 1), ("k", 1, -1), ("z", 1, 0), ("z", -1, 0), ("y", 2, 0), (None, 1, 0)]
    df = spark.createDataFrame(rows, "key string, refs long, exists long")
    whole = {tuple(r) for r in merge_counts(None, df).collect()}
    first = merge_counts(None, df.where(F.col("key") == "k"))
    assert {tuple(r) for r in merge_counts(first, df.where("key is null or key <> 'k'")).collect()} == whole
    assert {r.key for r in orphan_keys(merge_counts(None, df)).collect()} == {"k", "y", None}


def test_report_counts_every_field_and_table(spark, tables):
    sf = tables(
        evidence=([("a", "evidence:1", T[9], None), ("a", "evidence:2", T[1], T[2]), (None, "evidence:3", T[1], None)], "paper_id string, evidence_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
        blocks=([("a", "block:1", T[1])], "paper_id string, block_id string, ingested_at timestamp_ntz"),
        claims=([("a", "claim:1", ["evidence:1", "block:1"], T[1]), ("a", "claim:2", ["block:1"], T[1])], "paper_id string, claim_id string, evidence_ids array<string>, ingested_at timestamp_ntz"),
        citations=([("a", "c:1", ["evidence:2", "evidence:1"], T[1])], "paper_id string, citation_id string, cited_in_evidence_ids array<string>, ingested_at timestamp_ntz"),
        provenance=(
            [("a", "p:1", ["block:1", "Claim:1", "c:1", "record:1", "record:2", "evidence:2", "x"], T[1]), ("b", "p:2", ["record:1", "block:1"], T[1]), (None, "p:3", ["record:1", "evidence:3"], T[1])],
            "paper_id string, provenance_id string, source_ids array<string>, ingested_at timestamp_ntz",
        ),
        metadata=([("record:1", T[1], None), ("record:2", T[1], T[2])], "record_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
    )
    cl, ci, pv = "claims.evidence_ids", "citations.cited_in_evidence_ids", "provenance.source_ids"
    want = {(cl, "a", "block:1", 2), (ci, "a", "evidence:2", 1), (pv, "a", "record:2", 1), (pv, "a", "evidence:2", 1), (pv, "a", "x", 1), (pv, "b", "block:1", 1), (pv, None, "evidence:3", 1)}
    assert {tuple(r) for r in catalog.QUERIES["p4_current"](spark, sf).collect()} == want
