"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.t)
SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT s, CAST(min(t) AS BIGINT) AS component_id FROM reach GROUP BY s) c ON c.s = v.vec_id
"""

_SPACE = r"[ \t\n\r\x0b\x0c]+"
OP9 = rf"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, k, p[k] AS raw, regexp_replace(p[k], '^{_SPACE}|{_SPACE}$', '', 'g') AS line
  FROM parts, unnest(range(1, len(p) + 1)) AS r(k)
),
worded AS (
  SELECT doc_id, k, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, len(regexp_split_to_array(line, '{_SPACE}')) AS n
  FROM lines WHERE line <> ''
),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM worded),
own AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM worded GROUP BY doc_id),
runs AS (
  SELECT DISTINCT a.doc_id, a.i AS first, b.i AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND a.i <= b.i
  WHERE b.upto - a.upto + a.n >= 50 AND (b.upto - b.n - a.upto + a.n < 50 OR b.upto - a.upto < 50)
),
named AS (SELECT r.doc_id, first, last, ls[first:last] AS content FROM runs r JOIN own USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM named),
gone AS (SELECT DISTINCT doc_id, i FROM ranked, unnest(range(first, last + 1)) AS r(i) WHERE nth > 1),
gone_k AS (SELECT w.doc_id, w.k FROM worded w JOIN gone USING (doc_id, i)),
kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.k) FILTER (g.k IS NULL) AS text, count(g.k) AS n_deleted, count(*) FILTER (l.line <> '') AS n_lines
  FROM lines l LEFT JOIN gone_k g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN n_deleted = 0 THEN d.text ELSE coalesce(k.text, '') END AS text, k.n_lines, k.n_deleted
FROM documents d JOIN kept k USING (doc_id)
"""

OP12 = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(concat_ws(':', strlen(coalesce(role, '')), coalesce(role, ''), coalesce(text, '')))) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc AS (
  SELECT c, seq, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h FROM own
),
rebuilt AS (SELECT o.c, list_concat(coalesce(b.seq[1:o.h], []), o.seq[o.h + 1:]) AS seq FROM crc o LEFT JOIN own b ON b.c = o.c - o.c % 5),
prefixes AS (SELECT c, d, seq[1:d] AS path, len(seq) AS n FROM rebuilt, unnest(range(0, len(seq) + 1)) AS r(d)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(path[d].t), 0) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d
),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
grown AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
below AS (SELECT path[1:k] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM grown, unnest(range(0, d + 1)) AS r(k) GROUP BY 1)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(g.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM grown g JOIN below b ON b.path = g.path LEFT JOIN nodes p ON g.d > 0 AND p.path = g.path[1:g.d - 1]
"""

OP13 = r"""
WITH parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM parts, unnest(range(1, len(ws) - 48)) AS r(i)),
first AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT doc_id, i FROM windows JOIN first USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, i, ws[i] AS word FROM parts, unnest(range(1, len(ws) + 1)) AS r(i)),
marked AS (
  SELECT w.doc_id, w.i, w.word, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS 49 PRECEDING) AS removed
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
),
kept AS (SELECT doc_id, sum(removed) AS n, string_agg(word, ' ' ORDER BY i) FILTER (removed = 0) AS text FROM marked GROUP BY doc_id)
SELECT p.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM parts p LEFT JOIN kept k USING (doc_id)
"""
