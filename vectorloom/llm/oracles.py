"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from vectorloom.llm import mixing
from vectorloom.llm.secret_scan import BASE_RULES, RULES

ORACLES: dict[str, str] = {}
WORD = r"[^ \x09-\x0D]+"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_spans() -> str:
    """One row per span: position i of a match is all text between matches before it, and their lengths."""
    parts = []
    for place, rule in enumerate(RULES):
        pattern = quoted(rule.pattern)
        parts.append(f"""
        SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, start, start + length(found[i]) AS "end"
        FROM (SELECT doc_id, i, found, held,
                     coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                     + coalesce(list_sum(list_transform(found[1:i-1], lambda m: length(m))), 0) AS start
              FROM (SELECT doc_id, found, held, gaps, unnest(range(1, len(found) + 1)) AS i
                    FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS found,
                                 regexp_extract_all(t, {pattern}, {rule.group}) AS held,
                                 string_split_regex(t, {pattern}) AS gaps
                          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))))
        WHERE length(held[i]) >= {rule.least}""")
    return " UNION ALL ".join(parts)


ITEM = """kind || ':' || start || ':' || "end\""""
COUNTS = ", ".join(
    f"CAST(count(*) FILTER (kind = '{rule.kind}') AS BIGINT) AS n_{rule.kind}" for rule in BASE_RULES
)
ORACLES["op1_secret_scans"] = f"""
WITH spans AS ({secret_spans()})
SELECT d.doc_id, {COUNTS},
       sha256(coalesce(string_agg({ITEM}, ',' ORDER BY start, place) FILTER (place < {len(BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg({ITEM}, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
ORACLES["op4_warc_archives"] = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
digests AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS digest FROM rows),
firsts AS (SELECT digest, min(page_id) AS first FROM digests WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM digests d LEFT JOIN firsts f ON d.digest = f.digest"""
