"""DuckDB SQL for the longer of the numbered queries."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.other = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least_id, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY 1) m USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([CAST(n AS BIGINT)], list_transform(range(8), lambda x: CAST(x AS BIGINT))), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS tk, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
crc AS (SELECT d.* EXCLUDE (b), xor(list_reduce(list_concat([4294967295], list_transform(b, lambda x: CAST(('0x' || x) AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM d, crc_table),
j AS (SELECT doc_id, h, tk, n, CAST(('0x' || substr(h, 1, 16)) AS UHUGEINT) AS k, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM d, (VALUES (8), (9)) s(n)
  UNION ALL SELECT doc_id, h, tk, n, (k * 2862933555777941757 + 1) % 18446744073709551616, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1) AS DOUBLE))) AS BIGINT) FROM j WHERE j < n),
s AS (SELECT DISTINCT doc_id, h, tk, n, b FROM j WHERE j >= n)
SELECT crc.doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(a.b AS INTEGER) AS shard, row_number() OVER (PARTITION BY a.b ORDER BY crc.h, crc.doc_id, size, crc.tk) - 1 AS slot, CAST(c.b AS INTEGER) AS grown_shard
FROM crc JOIN s a ON a.n = 8 AND a.h = crc.h AND a.tk = crc.tk JOIN s c ON c.n = 9 AND c.h = crc.h AND c.tk = crc.tk
"""

OP6 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits FROM p),
r AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) * 16 + CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) * 8 + CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) * 4 + CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) * 2 + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM r
"""
