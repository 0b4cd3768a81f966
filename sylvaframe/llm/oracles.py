"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id FROM s JOIN n USING (doc_id))
SELECT doc_id, n_shingles, class_id, component_id, doc_id = component_id AS kept FROM k JOIN c USING (doc_id)
"""

MIXING = r"""
WITH m AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM m GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / wt AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lev FROM f WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS lev),
t AS (SELECT source, source_size, least(cap, coalesce(q.lev * wt, cap)) AS target FROM l, q),
g AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS whole, target - CASE WHEN target >= source_size THEN source_size ELSE 0 END AS need FROM t),
u AS (SELECT source, h, sum(size)::BIGINT AS sz FROM m GROUP BY source, h),
c AS (SELECT source, h, sz, sum(sz) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM u),
b AS (SELECT c.source, c.h, c.sz, c.upto, g.need FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE c.upto >= g.need QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY c.h) = 1),
z AS (SELECT g.*, CASE WHEN g.need <= 0 THEN -1 WHEN b.sz - (b.need - (b.upto - b.sz)) < b.need - (b.upto - b.sz) THEN b.h ELSE b.h - 1 END AS cut FROM g LEFT JOIN b ON g.source IS NOT DISTINCT FROM b.source)
SELECT m.doc_id, m.size, z.source_size, z.target, (m.size * (z.whole + CASE WHEN m.h <= coalesce(z.cut, -1) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m JOIN z ON m.source IS NOT DISTINCT FROM z.source
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item_id, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
dn AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM dw),
hit AS (SELECT doc_id, dn.n, i, item_id FROM dn JOIN win USING (n, w)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

NEGATIVES = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS v FROM q WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
s AS (SELECT a.row_id AS anchor, a.vec_id AS anchor_id, c.row_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, row_id AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND anchor <> row_id QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id) <= 10
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
n AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT i, item_id, unnest(ws) AS t FROM i),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, docs),
s AS (SELECT i, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN n USING (r), g GROUP BY i, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
