"""DuckDB twins of the registered queries that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def folded(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{UPPER.lower()}')"


def words(column: str) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), '[^\\x20\\x09-\\x0D]+')"


OP5 = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
), l AS (
    SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
    SELECT *, {folded(f"trim(line, {BLANKS})")} AS key FROM l
), hot AS (
    SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), m AS (
    SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


OP8 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
    SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p
)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def shingled(table: str, key: str) -> str:
    """Distinct five-word shingles (as texts) per row of a table."""
    return f"""
    SELECT {key}, unnest(list_distinct(CASE
        WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
        WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM (SELECT {key}, {words(folded("text"))} AS w FROM {table})"""


OP9 = f"""
WITH i AS ({shingled("benchmark", "item_id")}),
classes AS (
    SELECT min(item_id) AS item_id, count(*) AS item_copies, any_value(n) AS item_shingles,
           string_agg(item_id, ',' ORDER BY item_id) AS members
    FROM (SELECT item_id, count(*) AS n, list_sort(list(s)) AS ss FROM i GROUP BY item_id)
    GROUP BY ss
), wanted AS (
    SELECT c.*, i.s FROM classes c JOIN i USING (item_id)
), d AS ({shingled("documents", "doc_id")})
SELECT doc_id, item_id, item_copies, item_shingles, count(*) AS found,
       count(*) / item_shingles AS containment, members
FROM d JOIN wanted USING (s)
GROUP BY doc_id, item_id, item_copies, item_shingles, members
HAVING count(*) * 5 >= item_shingles * 4
"""


OP10 = f"""
WITH RECURSIVE s AS MATERIALIZED ({shingled("documents", "doc_id")}),
n AS MATERIALIZED (SELECT doc_id, count(s) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT a AS doc_id, a AS r FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.r
), low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(d.doc_id, coalesce(low.component_id, d.doc_id)) AS component_id,
       coalesce(low.component_id, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def terms(column: str) -> str:
    gaps = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
    return f"regexp_extract_all(coalesce({folded(column)}, ''), '[^{gaps}]+')"


OP13 = f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, {terms("text")} AS w FROM documents
), c AS (
    SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), i AS (
    SELECT iid, item_id, t, count(*) AS times FROM (
        SELECT row_number() OVER () AS iid, item_id, unnest({terms("text")}) AS t FROM benchmark
    ) GROUP BY ALL
), p AS MATERIALIZED (
    SELECT rid, doc_id, size, t, count(*) AS tf
    FROM (SELECT rid, doc_id, len(w) AS size, unnest(w) AS t FROM d)
    WHERE t IN (SELECT t FROM i) GROUP BY ALL
), f AS (
    SELECT t, CAST(floor(1000 * ln((2 * any_value(c.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM p, c GROUP BY t
), x AS (
    SELECT rid, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l)) AS impact
    FROM p, c
), s AS (
    SELECT iid, item_id, doc_id, CAST(sum(w * times * impact) AS BIGINT) AS score
    FROM i JOIN f USING (t) JOIN x USING (t) GROUP BY iid, item_id, rid, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 20
"""


# crc32 of the decimal id, bit by bit
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda i: (ord(ch) >> i) & 1)))),
    lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1))))"""

OP11 = f"""
WITH t AS MATERIALIZED (
    SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           length(coalesce(text, '')) AS size,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS MATERIALIZED (
    SELECT c, {CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM t)
), b AS (
    SELECT ids.c, t.p, t.key, t.size FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND t.p <= ids.h
    UNION ALL SELECT ids.c, t.p, t.key, t.size FROM ids JOIN t ON t.c = ids.c AND t.p > ids.h
), m AS MATERIALIZED (
    SELECT c, row_number() OVER w AS d, string_agg(key, '') OVER (w ROWS UNBOUNDED PRECEDING) AS k, size
    FROM b WINDOW w AS (PARTITION BY c ORDER BY p)
    UNION ALL SELECT c, 0, '', 0 FROM ids
), n AS MATERIALIZED (
    SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(size) AS size FROM m GROUP BY k, d
), ch AS (
    SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), e AS (
    SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends
    FROM (SELECT c, arg_max(k, d) AS k FROM m GROUP BY c) GROUP BY k
), sub AS (
    SELECT m.k, CAST(sum((n.n - 1) * n.size) AS BIGINT) AS saved_tokens,
           count(*) FILTER (ch.n_children IS NULL) AS n_leaves
    FROM n JOIN m ON m.c = n.conv_id AND m.d <= n.d LEFT JOIN ch ON ch.k = n.k GROUP BY m.k
)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN up.conv_id END AS parent_conv_id, n.n AS n_convs,
       coalesce(ch.n_children, 0) AS n_children, sub.n_leaves, sub.saved_tokens,
       sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN sub ON sub.k = n.k LEFT JOIN ch ON ch.k = n.k LEFT JOIN e ON e.k = n.k
LEFT JOIN n AS up ON up.k = left(n.k, 32 * greatest(n.d - 1, 0))
"""
