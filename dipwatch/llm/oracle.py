"""SQL of the queries that SQL can express, written against the contracts and not against the Spark plans.

SQL's lower() also folds letters beyond A-Z, so the contracts' folding is spelled out with translate().
"""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[^x]', '', 'g')), 0) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
fill AS (
  SELECT 0 AS step, source, source_size, weight, cap, budget, FALSE AS stopped FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight, cap, budget,
         stopped OR weight * (budget - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0))
           / nullif(sum(CASE WHEN NOT stopped THEN weight END) OVER (), 0) > cap
  FROM fill WHERE step < 40),
last AS (SELECT * FROM fill WHERE step = 40),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE least(cap, weight
           * (budget - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT stopped THEN weight END) OVER ()) END AS target
  FROM last),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       CASE WHEN source_size = 0 THEN 0 ELSE (floor(floor(target) / source_size) * size + greatest(0, least(size,
         floor(target) - floor(floor(target) / source_size) * source_size - before)))::BIGINT END AS taken
FROM o
"""

OP5 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE
         list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
n AS (SELECT rid, doc_id, len(s)::BIGINT AS n FROM g),
p AS (SELECT rid, unnest(s) AS x FROM g),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM p a JOIN p b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.rid = c.a JOIN n y ON y.rid = c.b WHERE 100 * c.common >= 90 * (x.n + y.n - c.common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rid, rid AS seen FROM n UNION SELECT r.rid, u.b FROM r JOIN u ON r.seen = u.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(m.doc_id) AS component_id
FROM r JOIN n ON n.rid = r.rid JOIN n m ON m.rid = r.seen GROUP BY n.rid, n.doc_id
"""

OP10 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM bw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bg),
dg AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - m + 2)) AS t(i)),
hit AS (SELECT dg.rid, dg.i, dg.m, bg.item_id FROM dg JOIN bg ON dg.m = bg.m AND dg.g = bg.g),
words AS (SELECT DISTINCT rid, unnest(range(i, i + m)) AS at FROM hit),
nw AS (SELECT rid, count(*) AS n_hit FROM words GROUP BY rid),
ni AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nw USING (rid) LEFT JOIN ni USING (rid)
"""

_OP11_ROUND = """
a{n} AS MATERIALIZED (
  SELECT row, arg_min(j, [d, j]) AS j, min(d) AS d FROM (
    SELECT row, j, list_sum(list_transform(list_zip(p, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v, c{n})
  GROUP BY row),
c{m} AS MATERIALIZED (
  SELECT c.j, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT j, list(x ORDER BY dim) AS c FROM (
      SELECT j, dim, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x
      FROM (SELECT a.j, unnest(v.p) AS x, generate_subscripts(v.p, 1) AS dim FROM a{n} a JOIN v USING (row)) GROUP BY j, dim)
    GROUP BY j) s USING (j)),"""

OP11 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, vec_id, p) - 1 AS j, p AS c FROM (
    SELECT sha256('3:' || vec_id) AS h, vec_id, p FROM v ORDER BY 1, 2, 3 LIMIT 8)),""" + "".join(
    _OP11_ROUND.format(n=n, m=n + 1) for n in range(10)) + """
a10 AS (
  SELECT row, arg_min(j, [d, j]) AS j, min(d) AS d FROM (
    SELECT row, j, list_sum(list_transform(list_zip(p, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v, c10)
  GROUP BY row)
SELECT v.vec_id, a10.j::INTEGER AS cluster, a10.d::BIGINT AS distance, (sum(a10.d) OVER (PARTITION BY a10.j))::BIGINT AS cluster_inertia,
       (sum(a10.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.c, ',')) AS centroid_sha256
FROM a10 JOIN v USING (row) JOIN c10 ON a10.j = c10.j
"""

ORACLE = {"op2_mix_sources": OP2, "op5_jaccard_join": OP5, "op10_contamination": OP10, "op11_centroids": OP11}
