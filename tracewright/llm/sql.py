"""DuckDB SQL of the queries that SQL expresses in several steps."""

_ASSIGN = """
a{r} AS MATERIALIZED (
  SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT q.rid, c.k, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c{r} c ON q.i = c.i GROUP BY q.rid, c.k) GROUP BY rid)"""
_UPDATE = """
c{n} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c.x)::BIGINT AS x FROM c{r} c
  LEFT JOIN (SELECT a.k, q.i, sum(q.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN q ON q.rid = a.rid GROUP BY a.k, q.i) m ON m.k = c.k AND m.i = c.i)"""

OP11 = (
    """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (
  SELECT rid, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x FROM kept),
seeds AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT 40),
c0 AS MATERIALIZED (SELECT s.k, q.i, q.x FROM seeds s JOIN q USING (rid)),"""
    + ",".join(_ASSIGN.format(r=r) + "," + _UPDATE.format(r=r, n=r + 1) for r in range(5))
    + ","
    + _ASSIGN.format(r=5)
    + """,
digests AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY k)
SELECT kept.vec_id, a5.k::INTEGER AS cluster, a5.d AS distance, (sum(a5.d) OVER (PARTITION BY a5.k))::BIGINT AS cluster_inertia,
       (sum(a5.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN kept USING (rid) JOIN digests ON digests.k = a5.k
"""
)

OP12 = r"""
WITH tokens AS MATERIALIZED (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL)),
windows AS MATERIALIZED (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER w = 50 THEN md5(array_to_string(list(word) OVER w, ' ')) END AS body FROM tokens
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT body, min(doc_id) AS first_id FROM windows WHERE body IS NOT NULL GROUP BY body),
marked AS (SELECT w.doc_id, w.i, w.word, (f.first_id < w.doc_id)::INTEGER AS dup FROM windows w LEFT JOIN firsts f ON w.body = f.body),
covered AS (
  SELECT doc_id, i, word, coalesce(max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM marked),
cut AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)
"""

OP13 = r"""
WITH rule AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
tokens AS MATERIALIZED (
  SELECT kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
hexes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM tokens)),
words AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexes, rule),
counts AS (
  SELECT b.bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM tokens JOIN words b USING (word) GROUP BY b.bucket),
sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counts),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM tokens JOIN words USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.place <= 10 * r.n // 100 THEN r.place END AS rank
FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
