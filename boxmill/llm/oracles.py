"""SQL for the operators whose results plain joins can give on small tables: all pairs that share a shingle, or a label."""

from __future__ import annotations

#: The end of a query over common table expressions nodes (id) and links (x, y).
_REACH = """edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, edges.y FROM reach JOIN edges ON reach.r = edges.x),
components AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), sizes AS (
  SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * p.n >= 85 * (a.n + b.n - p.n)
), nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN components ON id = doc_id
"""

OP3_SQL = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
degrees AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN components ON id = vec_id LEFT JOIN degrees ON x = vec_id
"""
