"""DuckDB SQL for operators whose results it can express, by brute force: no hashing, no candidates, every window and pair.

Its work grows with the square of what repeats, so it is for small tables.
"""

# windows of 50 bytes, as hexadecimal digits; pieces of 1024 windows keep substr() from walking long texts again and again
SUFFIX_DEDUP = """
WITH doc AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (
  SELECT doc_id, n, 1024 * k AS base, substr(h, 2048 * k + 1, 2146) AS p FROM (SELECT *, unnest(range(0, greatest(0, n - 49), 1024)) // 1024 AS k FROM doc)
), win AS MATERIALIZED (
  SELECT doc_id, base + j AS i, substr(p, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1024, n - 49 - base))) AS j FROM piece)
), low AS (
  SELECT s, min(doc_id) AS least_id FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i FROM win JOIN low USING (s) WHERE least_id < doc_id
), run AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)
), span AS (
  SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(kept, '' ORDER BY a) AS prefix, max(b) AS tail
  FROM (SELECT s.*, substr(d.h, 2 * prior + 1, 2 * (a - prior)) AS kept
    FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM span) s JOIN doc d USING (doc_id))
  GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(prefix, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS MATERIALIZED (
  SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON x.r <> y.r AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), reach(a, b) AS (
  SELECT r, r FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), class AS (
  SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = v.r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN class USING (r)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 5 * common.n >= 4 * (sa.n + sb.n - common.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), class AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
)
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE link.a = doc.doc_id) AS n_links, doc_id = class_id AS kept FROM doc JOIN class USING (doc_id)
"""
