"""All queries of this subpackage, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from scholiast.llm import encoding, lookalike, matching, names, packing, sentences, subjects

QUERIES = {
    "p1_found": lookalike.p1_found,
    "p1_form": lookalike.p1_form,
    "p2_found": sentences.p2_found,
    "p3_found": names.p3_found,
    "p3_clusters": names.p3_clusters,
    "p5_found": matching.p5_found,
    "p5_matches": matching.p5_matches,
    "p8_packed": packing.p8_packed,
    "p8_fill": packing.p8_fill,
    "p9_found": subjects.p9_found,
    "p9_subjects": subjects.p9_subjects,
    "p9_makeup": subjects.p9_makeup,
    "p7_ids": encoding.p7_ids,
}

SQL = {
    "p1_form": lookalike.P1_FORM_SQL,
}
