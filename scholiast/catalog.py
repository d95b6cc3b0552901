"""All queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from scholiast.operators import orphans, packed_values
from scholiast.plans import citations, content, corpus, evidence, graphs, layout, pages, reader, registry

QUERIES = {
    "p4_found": orphans.p4_found,
    "p4_monthly": orphans.p4_monthly,
    "p4_current": orphans.p4_current,
    "p6_found": packed_values.p6_found,
}

_REFS = """
refs AS (
  SELECT ref_field, paper_id, owner_id, ref_id, min(ingested_at) AS ref_at FROM (
    SELECT 'claims.evidence_ids' AS ref_field, paper_id, claim_id AS owner_id, lower(trim(unnest(evidence_ids))) AS ref_id, ingested_at FROM claims
    UNION ALL SELECT 'citations.cited_in_evidence_ids', paper_id, citation_id, lower(trim(unnest(cited_in_evidence_ids))), ingested_at FROM citations
    UNION ALL SELECT 'provenance.source_ids', paper_id, provenance_id, lower(trim(unnest(source_ids))), ingested_at FROM provenance)
  WHERE ref_id <> '' GROUP BY ALL)
"""
_ORPHANS = f"""
WITH {_REFS},
named AS (
  SELECT 'e' AS kind, paper_id, lower(trim(evidence_id)) AS ref_id, min(ingested_at) AS came, max(deleted_at) AS gone FROM evidence GROUP BY ALL
  UNION ALL SELECT 'o', paper_id, lower(trim(block_id)), min(ingested_at), NULL FROM blocks GROUP BY ALL
  UNION ALL SELECT 'o', paper_id, lower(trim(claim_id)), min(ingested_at), NULL FROM claims GROUP BY ALL
  UNION ALL SELECT 'o', paper_id, lower(trim(citation_id)), min(ingested_at), NULL FROM citations GROUP BY ALL
  UNION ALL SELECT 'r', NULL, lower(trim(record_id)), min(ingested_at), max(deleted_at) FROM metadata GROUP BY ALL),
orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM named n WHERE n.ref_id = r.ref_id AND n.came <= r.ref_at AND (n.gone IS NULL OR n.gone > r.ref_at)
      AND CASE WHEN r.ref_field = 'provenance.source_ids' THEN n.kind = 'r' OR n.paper_id = r.paper_id ELSE n.kind = 'e' AND n.paper_id = r.paper_id END))
"""

SQL = {
    "p4_found": _ORPHANS + "SELECT ref_field, paper_id, owner_id, ref_id FROM orphans",
    "p4_monthly": _ORPHANS + "SELECT ref_field, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY ALL",
    "p4_current": f"""
WITH {_REFS},
live AS (
  SELECT 'e' AS kind, paper_id, lower(trim(evidence_id)) AS ref_id FROM evidence WHERE deleted_at IS NULL
  UNION SELECT 'o', paper_id, lower(trim(block_id)) FROM blocks
  UNION SELECT 'o', paper_id, lower(trim(claim_id)) FROM claims
  UNION SELECT 'o', paper_id, lower(trim(citation_id)) FROM citations
  UNION SELECT 'r', NULL, lower(trim(record_id)) FROM metadata WHERE deleted_at IS NULL)
SELECT ref_field, paper_id, ref_id, count(*) AS refs FROM refs r WHERE NOT EXISTS (
  SELECT 1 FROM live n WHERE n.ref_id = r.ref_id
    AND CASE WHEN r.ref_field = 'provenance.source_ids' THEN n.kind = 'r' OR n.paper_id = r.paper_id ELSE n.kind = 'e' AND n.paper_id = r.paper_id END)
GROUP BY ALL""",
}

for _module in (layout, evidence, citations, graphs, corpus, pages, reader, content, registry):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
