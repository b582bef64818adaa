"""DuckDB forms of the queries that SQL can express over whole tables; the others are held against plain Python in the tests."""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {
    "op1_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.label) AS component_id, min(r.label) = d.doc_id AS kept FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op4_substring": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS low FROM x GROUP BY 1),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN m ON m.k = x.k WHERE low < x.doc_id)),
v AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
kept AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.j) AS t, count(*) AS c FROM v LEFT JOIN g ON g.doc_id = v.doc_id AND g.j = v.j WHERE g.j IS NULL GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op8_warc": """
WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM h),
b AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5) AS INTEGER) >> d) & 31) + 1, 1)), '')), '') AS digest FROM s)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b""",
    "op10_decontaminate": f"""
WITH b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
ms AS (SELECT DISTINCT m FROM bw), d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM documents),
x AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms)),
h AS (SELECT doc_id, i, x.m, item FROM x JOIN bw ON bw.k = x.k AND bw.m = x.m),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}
