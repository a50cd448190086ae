"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from lynceus.llm.common import UPPER

OP8 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw USING (k, win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
m AS (SELECT data, max(page_id) AS last FROM p WHERE octet_length(data) >= 1000 GROUP BY data)
SELECT page_id, CAST(octet_length(p.data) AS BIGINT) AS payload_bytes, sha1(p.data) AS payload_digest,
  CASE WHEN coalesce(page_id = last, TRUE) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m USING (data)
"""

#: CRC-32 of a decimal number, byte by byte and bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda v, x: list_reduce(list_prepend(xor(v, x), range(8)),
    lambda w, k: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384::BIGINT) ELSE w >> 1 END)), 4294967295::BIGINT)"""

OP11 = f"""
WITH o AS (
  SELECT c, strlen(t) AS b, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS p
  FROM (SELECT conv_id AS c, turn, coalesce(text, '') AS t,
          md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x
        FROM conversations WHERE conv_id IS NOT NULL)),
cs AS (SELECT c, {CRC} % 9 AS h FROM (SELECT DISTINCT c FROM o)),
taken AS (SELECT cs.c, o.p AS d, x, b FROM cs JOIN o ON o.c = cs.c - cs.c % 5 AND o.p <= h),
k AS (SELECT c, count(*) AS k FROM taken GROUP BY c),
turns AS (
  SELECT * FROM taken
  UNION ALL SELECT o.c, coalesce(k, 0) + p - h, x, b FROM o JOIN cs USING (c) LEFT JOIN k USING (c) WHERE p > h),
prefixes AS (
  SELECT c, d, b, md5(string_agg(x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM cs),
nodes AS (SELECT d, key, min(c) AS m, count(*) AS n, min(b) AS b FROM prefixes GROUP BY d, key),
named AS (SELECT c, d, m FROM prefixes JOIN nodes USING (d, key)),
parents AS (SELECT nodes.m, nodes.d, named.m AS parent FROM nodes JOIN named ON named.c = nodes.m AND named.d = nodes.d - 1),
children AS (SELECT parent AS m, d - 1 AS d, count(*) AS n_children FROM parents GROUP BY ALL),
own AS (SELECT nodes.m, nodes.d, n, b, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (m, d)),
below AS (
  SELECT named.m, named.d, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n - 1) * b)::BIGINT AS saved_tokens
  FROM own JOIN named ON named.c = own.m AND named.d <= own.d GROUP BY ALL),
ends AS (
  SELECT m, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM named JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT m AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN below USING (m, d) LEFT JOIN parents USING (m, d) LEFT JOIN ends USING (m, d)
"""

ORACLES: dict[str, str] = {"op8_decontamination": OP8, "op11_prefix_trie": OP11, "op12_warc": OP12}
