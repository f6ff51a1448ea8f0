"""DuckDB SQL for operators whose results plain SQL can give another way: near duplicates and the license
scan on words instead of hashes, the conversation trie on texts, vector search and codes on all pairs."""

from __future__ import annotations

from bourse.llm.license import BASE, LICENSES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
                     FROM documents),
s AS (SELECT doc_id, CASE
        WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(
             ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])))
        WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
      WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, g.b FROM r JOIN g ON r.reach = g.a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN m ON m.node = n.doc_id
"""

_TEMPLATES = ", ".join(f"({t}, '{label}', {t < len(BASE)}, string_split('{text}', ' '))"
                       for t, (label, text) in enumerate([*BASE, *LICENSES]))

LICENSE_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(template, label, is_base, ws)),
tg AS (SELECT template, label, is_base, len(ws) - 1 AS n_grams, p AS tpos, ws[p + 1] || ' ' || ws[p + 2] AS gram
       FROM (SELECT *, unnest(range(0, len(ws) - 1)) AS p FROM t)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
dg AS (SELECT doc_id, p AS pos, ws[p + 1] || ' ' || ws[p + 2] AS gram
       FROM (SELECT *, unnest(range(0, len(ws) - 1)) AS p FROM d)),
v AS (SELECT doc_id, template, label, is_base, n_grams, pos - tpos AS diagonal, min(pos) AS lo, max(pos) AS hi,
             list(DISTINCT tpos) AS covered FROM dg JOIN tg ON dg.gram = tg.gram GROUP BY ALL),
c AS (SELECT *, CASE WHEN NOT is_base AND diagonal - lag(diagonal) OVER w <= 2
                      AND lo <= max(hi) OVER (PARTITION BY doc_id, template ORDER BY diagonal
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + n_grams
                     THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM c),
m AS (SELECT doc_id, template, label, is_base, n_grams, run, min(lo) AS start, max(hi) + 2 AS stop,
             len(list_distinct(flatten(list(covered)))) AS n_covered FROM u GROUP BY ALL),
k AS (SELECT * FROM m WHERE CASE WHEN is_base THEN n_covered = n_grams
      ELSE n_covered >= 0.8 * n_grams AND stop - start <= ceil((n_grams + 1) * 1.5) END)
SELECT d.doc_id, CAST(len(any_value(d.ws)) AS BIGINT) AS n_words, count(k.start) FILTER (k.is_base) AS n_base,
       min(k.start) FILTER (k.is_base) AS first_word, max(k.start) FILTER (k.is_base) AS last_word,
       coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label) FILTER (k.is_base), '') AS base_labels,
       coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label), '') AS labels,
       coalesce(max(CASE WHEN k.n_grams > 0 THEN k.n_covered / k.n_grams END), 0.0) AS score
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""

# a prefix is the text of its turns; sums below a node go over the paths of the nodes' smallest members
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (SELECT CAST(i AS BIGINT) AS i, list_reduce(list_prepend(CAST(i AS BIGINT), range(0, 8)),
               lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(0, 256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM crc),
h AS (SELECT conv_id, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
             string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda x, y: xor(x // 256, v[CAST(xor(x % 256, y) + 1 AS INT)])), 4294967295) % 9 AS h FROM bits, tab),
r AS (SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.pos <= h.h
      UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
p AS (SELECT conv_id, depth, strlen(text) AS bytes,
             string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM d
      UNION ALL SELECT conv_id, 0, 0, '' FROM bits),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT p.k, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.bytes) AS bytes,
             coalesce(string_agg(CASE WHEN e.depth = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '') AS ends
      FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY p.k, p.depth),
c AS (SELECT n.*, u.conv_id AS parent_conv_id, u.k AS up
      FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = left(n.k, CAST(length(n.k) - 32 AS BIGINT))),
kids AS (SELECT up AS k, count(*) AS n FROM c WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved
          FROM c LEFT JOIN kids ON kids.k = c.k JOIN p a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.k)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM c LEFT JOIN kids ON kids.k = c.k JOIN below ON below.k = c.k
"""

_KEPT = """SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

TOP_SQL = f"""
WITH k AS ({_KEPT.format(scale=1024)}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM k q JOIN k c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def _assigned(books: str) -> str:
    return f"""SELECT p.vec_id, p.label, p.part, p.x, min(64 * list_sum(list_transform(range(1, len(p.x) + 1),
       lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i]))) + b.entry) AS best
FROM p JOIN {books} b ON b.part = p.part GROUP BY ALL"""


def _moved(books: str, found: str) -> str:
    return f"""SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
  SELECT part, entry, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, best % 64 AS entry, i, sum(x[i]) AS total, count(*) AS n
    FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {found}) GROUP BY ALL) GROUP BY part, entry) m
  ON m.part = b.part AND m.entry = b.entry"""


CODES_SQL = f"""
WITH k AS ({_KEPT.format(scale=256)}),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x
      FROM (SELECT *, unnest(range(0, 16)) AS part FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p.part, f.entry, p.x AS c FROM p JOIN f ON f.vec_id = p.vec_id),
a0 AS MATERIALIZED ({_assigned("c0")}),
c1 AS MATERIALIZED ({_moved("c0", "a0")}),
a1 AS MATERIALIZED ({_assigned("c1")}),
c2 AS MATERIALIZED ({_moved("c1", "a1")}),
a2 AS MATERIALIZED ({_assigned("c2")}),
r AS (SELECT vec_id, label, string_agg(format('{{:02x}}', CAST(best % 64 AS INT)), '' ORDER BY part) AS code,
             CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
g AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) AS s FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(g.s) AS codebooks_sha256
FROM r, g
"""
