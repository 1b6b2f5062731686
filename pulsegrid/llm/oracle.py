"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {}

ORACLE["op4_mixing"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, source,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS lim,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s),
f AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
t AS (
  SELECT source, source_size,
         least(lim, weight * coalesce(max(CASE WHEN (budget - bef) / rest <= lim / weight THEN (budget - bef) / rest END) OVER (), 1e300)) AS target
  FROM f),
q AS (
  SELECT d.r, d.doc_id, d.h, d.source, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, unnest([0, 1]) AS use FROM q WHERE size > 0 AND target > 0),
e AS (SELECT *, CAST(start + use * source_size + size AS DOUBLE) / target AS finish FROM u),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, h, doc_id NULLS FIRST, use, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e),
k AS (SELECT r, sum(greatest(0, least(size, (SELECT floor(sum(target) + 1e-6) FROM t) - ahead))) AS taken FROM c GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (r)
"""

ORACLE["op5_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * x::DOUBLE) AS DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
"""

ORACLE["op13_audit"] = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM b p, b q, b r, b s, b t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
   AND len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
z AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS bef FROM k),
g AS (
  SELECT m.part, z.filter_order, z.step, z.own,
         sum(CASE WHEN m.mask & (z.own + z.bef) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m.mask & z.own <> 0 AND m.mask & z.bef = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m.mask & z.own <> 0 AND m.mask & z.bef <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m.mask = z.own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m.mask & z.own <> 0 AND m.mask & z.bef = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN m.mask & z.own <> 0 AND m.mask & z.bef = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN z GROUP BY m.part, z.filter_order, z.step, z.own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""

ORACLE["op11_resampling"] = """
WITH RECURSIVE z(b, k, v) AS (
  SELECT CAST(b AS BIGINT), 0, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM z WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS tab FROM z WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
df AS (
  SELECT r, unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]),
                               [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM d),
bf AS (
  SELECT unnest(list_concat(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]),
                            [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM b),
u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
c AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) for i in range(len(h) // 2)]),
                            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS k
  FROM u, tab),
dk AS (SELECT r, k, count(*) AS n FROM df JOIN c USING (f) GROUP BY r, k),
s AS (SELECT k, sum(n) AS s FROM dk GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN c USING (f) GROUP BY k),
g AS (
  SELECT s.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS gain
  FROM s LEFT JOIN t ON s.k = t.k),
x AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM dk JOIN g USING (k) GROUP BY r),
y AS (
  SELECT d.doc_id, len(w) AS words, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
         CAST('0x' || substr(sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN x ON d.r = x.r),
v AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS score FROM y),
o AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (WHERE words >= 20) OVER () AS enough
  FROM v)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN place <= 5 * enough // 100 THEN place END AS rank
FROM o
"""

ORACLE["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM p),
r AS (SELECT *, CASE WHEN first_id <> page_id OR page_id IS NULL THEN first_id END AS refers_to FROM f)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
