"""DuckDB SQL for the results of the registered queries, where SQL can express them."""

from __future__ import annotations

from . import queries, sharding

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 12), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM bw
), dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (phrase)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
), post AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d
), cf AS (
  SELECT term, count(*) AS cf FROM post GROUP BY term
), t AS (
  SELECT phrase, term, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(cf, 0), off) AS r, min(coalesce(cf, 0)) OVER (PARTITION BY phrase) AS least
  FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, len(string_split(phrase, ' ')))) AS off FROM (SELECT DISTINCT phrase FROM bw)) LEFT JOIN cf USING (term)
), q AS (
  SELECT DISTINCT item_id, a.term AS t1, b.term AS t2 FROM t a JOIN t b USING (phrase) JOIN bw USING (phrase) WHERE a.r = 1 AND b.r = 2 AND a.least > 0
), nr AS (
  SELECT x.doc_id, count(DISTINCT q.item_id) AS n_near
  FROM q JOIN post x ON x.term = q.t1 JOIN post y ON y.doc_id = x.doc_id AND y.term = q.t2 AND abs(x.pos - y.pos) BETWEEN 1 AND 13 GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) c USING (doc_id)
"""

# The table is a parameter of the query (a test fills it by brute force); placement is SQL's own.
OP2 = f"""
WITH t AS (
  SELECT string_split('{",".join(map(str, sharding.lookup_table(queries.SHARDS)))}', ',') AS k
), d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents
)
SELECT doc_id, slot, 'shard-' || lpad(k[slot + 1], 2, '0') AS shard FROM d, t
"""

ORACLES = {
    "op2_sharding": OP2,
    "op4_warc": OP4,
    "op6_jaccard": OP6,
    "op10_decontamination": OP10,
}
