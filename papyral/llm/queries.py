"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from papyral.llm.components import p2_found
from papyral.llm.incremental import p5_found
from papyral.llm.matching import p7_confidence, p7_found
from papyral.llm.mixing import p9_mix, p9_shares
from papyral.llm.names import p6_found
from papyral.llm.neighbours import p4_found, p4_neighbours
from papyral.llm.reading import p10_found
from papyral.llm.survivor import DATE_FIELDS, p3_dates, p3_found
from papyral.llm.tokens import p8_ids

QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_dates": p3_dates,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_confidence": p7_confidence,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

# Connected components by a recursive closure over the same links.
_P2 = r"""
WITH RECURSIVE keys AS (SELECT DISTINCT canonical_key AS k, doi, arxiv_id FROM papers WHERE canonical_key IS NOT NULL),
ids AS (
  SELECT k, 'd' || regexp_replace(regexp_extract(replace(replace(replace(lower(trim(doi)), '%2f', '/'), '%28', '('), '%29', ')'), '(10\.\d{4,9}/[^\s?#]+)', 1), '[.,;]+$', '') AS i FROM keys WHERE doi IS NOT NULL
  UNION SELECT k, 'a' || regexp_extract(lower(arxiv_id), '(\d{4}\.\d{4,5})', 1) FROM keys WHERE arxiv_id IS NOT NULL),
firsts AS (SELECT k, min(k) OVER (PARTITION BY i) AS f FROM ids WHERE length(i) > 1),
verdicts AS (SELECT least(left_key, right_key) AS u, greatest(left_key, right_key) AS v, arg_max(lower(trim(verdict)), (decided_at, lower(trim(verdict)) <> 'same')) AS w
  FROM match_pairs WHERE left_key <> right_key AND verdict IS NOT NULL GROUP BY 1, 2),
links AS (SELECT u, v FROM verdicts WHERE w = 'same' UNION SELECT k, f FROM firsts WHERE k <> f),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
walk(a, b) AS (SELECT u, u FROM edges UNION SELECT walk.a, edges.v FROM walk JOIN edges ON walk.b = edges.u),
roots AS (SELECT a AS k, min(b) FILTER (WHERE b IN (SELECT k FROM keys)) AS g FROM walk GROUP BY a)
SELECT k AS canonical_key, g AS group_key FROM roots WHERE k IN (SELECT k FROM keys)
"""

_FIELD = "CASE source " + " ".join(f"WHEN '{k}' THEN json_extract_string(raw, '{v}')" for k, v in DATE_FIELDS.items()) + " WHEN 'crossref' THEN CASE WHEN json_array_length(raw, '$.published.date-parts[0]') = 3 THEN concat_ws('-', json_extract_string(raw, '$.published.date-parts[0][0]'), json_extract_string(raw, '$.published.date-parts[0][1]'), json_extract_string(raw, '$.published.date-parts[0][2]')) END WHEN 'openreview' THEN epoch_ms(TRY_CAST(json_extract_string(raw, '$.cdate') AS BIGINT))::DATE::VARCHAR END"
_P3_DATES = rf"""
WITH latest AS (SELECT paper_id, source, max(struct_pack(a := first_seen_at, b := raw)) AS m FROM paper_sources WHERE paper_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
sound AS (SELECT paper_id, source, m.a AS seen, CASE WHEN json_valid(m.b) THEN m.b END AS raw FROM latest),
written AS (SELECT paper_id, source, seen, trim({_FIELD}) AS d FROM sound),
dated AS (SELECT paper_id, source, seen, CASE WHEN regexp_matches(d, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}($|[T ])') THEN TRY_CAST(regexp_extract(d, '^(\d{{4}}-\d{{1,2}}-\d{{1,2}})', 1) AS DATE)
  WHEN regexp_matches(d, '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN TRY_CAST(regexp_replace(d, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})$', '\3-\2-\1') AS DATE) END AS day FROM written),
real AS (SELECT paper_id, source, day, coalesce(trust_rank, 2147483647) AS r FROM dated LEFT JOIN source_trust USING (source) WHERE day BETWEEN DATE '1990-01-01' AND seen::DATE),
best AS (SELECT paper_id, arg_min(day, (r, source)) AS announce_date, arg_min(source, (r, source)) AS date_source FROM real GROUP BY 1)
SELECT paper_id, announce_date, coalesce(date_source, '') AS date_source FROM (SELECT DISTINCT paper_id FROM latest) LEFT JOIN best USING (paper_id)
"""

ORACLE_SQL = {"p2_found": _P2, "p3_dates": _P3_DATES}
