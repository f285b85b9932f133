"""SQL that gives the rows of the queries that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DARK = r"[^\x20\x09-\x0D]+"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM
  (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win USING (n, k)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_DARK}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_DARK}') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
low AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN low USING (k) WHERE doc_id > first)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT *, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
many AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
start AS (SELECT doc_id, p, max(p + 200) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM win SEMI JOIN many USING (k)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
  FROM start) GROUP BY doc_id, g),
each AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM span GROUP BY 1),
edges AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY x) AS t
  FROM edges JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE t END)) AS kept_sha256 FROM d LEFT JOIN each USING (doc_id) LEFT JOIN kept USING (doc_id)"""

PREFIX_TRIE = """
WITH turns AS (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'id': id, 'n': n} ORDER BY turn NULLS FIRST, id) AS t FROM turns GROUP BY 1),
crc AS (SELECT i, list_reduce([i] || range(1, 9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)),
crcs AS (SELECT list(v ORDER BY i) AS tab FROM crc),
h AS (SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, crcs),
r AS (SELECT o.conv_id AS c, coalesce(b.t, [])[:h.h] || o.t[h.h + 1:] AS t
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT c, d, array_to_string(list_transform(t[:d], lambda x: x.id), '') AS k, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n, d = len(t) AS ends
  FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(CASE WHEN ends THEN c END::VARCHAR, ',' ORDER BY c), '') AS e
  FROM p GROUP BY k, d),
kids AS (SELECT k[:-33] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
each AS (SELECT k, CASE WHEN k NOT IN (SELECT k FROM kids) THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * n AS saved, d FROM node),
sums AS (SELECT k[:32 * u] AS k, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM each) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, sha256(x.e) AS ends_sha256
FROM node x JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN node y ON x.d > 0 AND y.k = x.k[:-33]"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""

ORACLES = {"op1_decontaminate": CONTAMINATION, "op3_near_duplicates": NEAR_DUPLICATES, "op6_recompression": PASSAGES,
           "op10_suffix_array": REPEATED_BYTES, "op11_prefix_trie": PREFIX_TRIE,
           "op13_hard_negatives": HARD_NEGATIVES}
