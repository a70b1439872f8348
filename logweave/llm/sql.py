"""The same results in DuckDB's SQL, where SQL can express them."""

OP3 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


# components of links l(a, b), both directions, as the smallest id that is reachable
_REACH = """
reach(id, low) AS (SELECT a, least(a, b) FROM l UNION SELECT l.a, reach.low FROM l JOIN reach ON reach.id = l.b WHERE reach.low < l.a),
component AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
"""

OP1 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), {_REACH}, same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS group_id FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id))
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, t.doc_id) AS component_id, coalesce(component_id, t.doc_id) = t.doc_id AS kept, coalesce(group_id, t.doc_id) AS group_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN component ON component.id = t.doc_id LEFT JOIN same ON same.doc_id = t.doc_id
"""

OP4 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)
), hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
), word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t
), kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) >= 0.98 * x.n * y.n
), {_REACH}, links AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(links.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN links ON links.a = vec_id LEFT JOIN component ON component.id = vec_id
"""

OP6 = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w, 2.0::DOUBLE * sum(size) AS most FROM t GROUP BY source
), f AS (
  SELECT *, coalesce(sum(most) OVER before, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest, 1.5::DOUBLE * sum(source_size) OVER () AS all_ FROM s
  WINDOW before AS (ORDER BY most / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (SELECT *, (all_ - full_) / rest AS level FROM f
), m AS (SELECT arg_min(level, most / w) AS level FROM g WHERE level * w <= most
), b AS (SELECT source, source_size, CASE WHEN m.level IS NULL OR m.level * w >= most THEN most ELSE m.level * w END AS target FROM g, m
), k AS (
  SELECT t.*, source_size, target, floor(target)::BIGINT AS whole, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS key FROM t JOIN b ON t.source IS NOT DISTINCT FROM b.source
), u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, whole - epochs * source_size - (upto - size)))::BIGINT AS taken, source FROM u
"""

# base 32 of a SHA-1: each character has five bits, which lie in two hexadecimal digits
OP9 = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages
), d AS (SELECT *, list_transform(string_split(sha1(html), ''), lambda c: strpos('0123456789abcdef', c) - 1) AS x FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((x[1 + (5 * i) // 4] * 16 + coalesce(x[2 + (5 * i) // 4], 0)) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to, url
FROM d
"""

ORACLES = {"op1_minhash": OP1, "op3_exact_dedup": OP3, "op4_repeated_passages": OP4, "op6_mix_sources": OP6, "op7_embed_dedup": OP7, "op9_warc": OP9}
