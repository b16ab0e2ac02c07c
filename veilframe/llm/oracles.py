"""DuckDB SQL for those of the registered queries that SQL can express, from their contracts alone.

The rest have none: 1, 4, 7 and 12 fit or compare models in floating point, 2,
8, 10 and 13 call a tokenizer library.  Tests hold those against brute force.
"""

_TOP_K = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_SUBSTRING = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT r, unnest(range(1, octet_length(b) - 98)) AS s FROM docs WHERE octet_length(b) >= 100
), windows AS (
  SELECT t.r, t.s, array_slice(d.b, t.s, t.s + 99) AS w FROM starts t JOIN docs d ON d.r = t.r
), again AS (
  SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY w ORDER BY r, s) AS nth FROM windows) WHERE nth > 1
), begun AS (
  SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT r, min(s) AS a, max(s) + 99 AS z
  FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM begun) GROUP BY r, g
), gone AS (
  SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM spans GROUP BY r
), cut AS (
  SELECT d.doc_id, d.b, coalesce(g.a, CAST([] AS BIGINT[])) AS a, coalesce(g.z, CAST([] AS BIGINT[])) AS z FROM docs d LEFT JOIN gone g ON g.r = d.r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes,
       CAST(coalesce(list_sum(z), 0) - coalesce(list_sum(a), 0) + len(a) AS BIGINT) AS n_removed,
       CAST(len(a) AS BIGINT) AS n_spans,
       sha256(list_reduce(list_concat([encode('')], list_transform(range(1, len(a) + 2), lambda i:
         CASE WHEN (CASE WHEN i > len(a) THEN octet_length(b) ELSE a[i] - 1 END) > (CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END)
              THEN array_slice(b, (CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END) + 1, CASE WHEN i > len(a) THEN octet_length(b) ELSE a[i] - 1 END)
              ELSE encode('') END)), lambda x, y: x || y)) AS kept_sha256
FROM cut
"""

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY page_id, coalesce(html, '')) AS nth FROM pages
), f AS (
  SELECT *, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p
), t AS (
  SELECT *, first IS NOT NULL AND (page_id IS NULL OR page_id <> first OR nth > 1) AS again FROM f
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM t
"""

_JACCARD = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM docs
), sizes AS MATERIALIZED (
  SELECT r, count(*) AS n FROM sets GROUP BY r
), shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * shared.n >= 75 * (a.n + b.n - shared.n)
), edges AS MATERIALIZED (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(r, m) AS (
  SELECT r, r FROM docs
  UNION
  SELECT e.y, reach.m FROM reach JOIN edges e ON e.x = reach.r WHERE reach.m < e.y
), least AS (
  SELECT r, min(m) AS m FROM reach GROUP BY r
)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, f.doc_id AS component_id
FROM docs d JOIN least l ON l.r = d.r JOIN docs f ON f.r = l.m LEFT JOIN sizes ON sizes.r = d.r
"""

_KMEANS_ROUND = """
), a{n} AS MATERIALIZED (
  SELECT r, list_min(list_transform(c.m, lambda y: {{'d': CAST(list_sum(list_transform(range(1, 65), lambda i: (e[i] - y.x[i]) * (e[i] - y.x[i]))) AS BIGINT), 'j': y.j}})) AS b
  FROM v, (SELECT list({{'j': j, 'x': x}} ORDER BY j) AS m FROM c{n}) c
"""

_KMEANS_MOVE = """
), s{n} AS (
  SELECT j, i, sum(v) AS s, count(*) AS n
  FROM (SELECT a{n}.b.j AS j, unnest(e) AS v, unnest(range(1, 65)) AS i FROM v JOIN a{n} ON a{n}.r = v.r) GROUP BY j, i
), c{next} AS MATERIALIZED (
  SELECT c{n}.j, coalesce(m.x, c{n}.x) AS x
  FROM c{n} LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY j) m ON m.j = c{n}.j
"""

_KMEANS = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS j, e AS x FROM v QUALIFY j < 8
"""
    + "".join(_KMEANS_ROUND.format(n=n) + _KMEANS_MOVE.format(n=n, next=n + 1) for n in range(10))
    + _KMEANS_ROUND.format(n=10)
    + """
)
SELECT v.vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM v JOIN a10 ON a10.r = v.r JOIN c10 ON c10.j = b.j
"""
)

ORACLE_SQL: dict[str, str] = {"op3_exact_top_k": _TOP_K, "op5_substring_dedup": _SUBSTRING, "op6_warc_round_trip": _WARC, "op9_jaccard_join": _JACCARD, "op11_exponion_clusters": _KMEANS}
