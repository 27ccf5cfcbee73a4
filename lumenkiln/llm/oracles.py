"""DuckDB SQL for operators whose results SQL can express, by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_BLANKS = r"[^\x20\x09-\x0D]+"
_MARKS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_BLANKS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 5], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0) x
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 85 * (na.n + nb.n - same)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id, n.n
"""

OP8_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower('text')}, '{_MARKS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS k
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0) x
), d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_MARKS}') AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS k
  FROM (SELECT doc_id, size, w, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM windows) z WHERE len(w) >= size) x
), found AS (SELECT doc_id, i, p.size, item FROM places p JOIN windows USING (size, k)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) x GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20) x) y
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
marked AS (
  SELECT doc_id, i, word, bool_or(coalesce(again, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN windows USING (doc_id, i)
), summed AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN summed USING (doc_id)
"""
