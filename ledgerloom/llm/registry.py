"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op9_byte_bpe
from .common import load
from .html_extract import op3_html_extract
from .near_dedup import op2_near_dedup
from .ngram_join import op13_ngram_join
from .order_minhash import op8_order_minhash
from .packing import op7_packing
from .prefix_trie import op11_prefix_trie
from .quality import op5_quality
from .secret_scan import op4_secret_scan
from .source_audit import op12_source_audit
from .vector_search import op10_top_k
from .warc_zip import op6_warc_zip
from .substring_dedup import op1_substring_dedup

_ROWS = r"""
SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS ({_ROWS}),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 19) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op6_warc_zip": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p),
nib AS (SELECT *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(h, CAST(i AS INT) + 1, 1)) - 1) AS x FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x[(5 * i) // 4 + 1] * 16 + CASE WHEN (5 * i) // 4 + 2 <= 40 THEN x[(5 * i) // 4 + 2] ELSE 0 END) // CAST(pow(2, 3 - (5 * i) % 4) AS INT)) % 32 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM nib
""",
    "op10_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || text)[:32] || printf('%08X', len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS id FROM t),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS l, [4294967295] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT)) AS b FROM i GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce(b, lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 4 AS h FROM own),
r AS (SELECT a.conv_id, list_concat(list_slice(coalesce(b.l, []), 1, a.h), list_slice(a.l, a.h + 1, len(a.l))) AS l FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, len(l) AS n, d, list_slice(l, 1, d) AS ids FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT ids, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
             CASE WHEN d = 0 THEN 0 ELSE CAST('0x' || any_value(ids[d])[33:] AS BIGINT) END AS words FROM p GROUP BY ids, d),
k AS (SELECT list_slice(ids, 1, d - 1) AS ids, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.d = k.d AND n.ids = k.ids),
s AS (SELECT list_slice(ids, 1, a) AS ids, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.d = f.d AND s.ids = f.ids LEFT JOIN n u ON u.d = f.d - 1 AND u.ids = list_slice(f.ids, 1, f.d - 1)
""",
    "op12_source_audit": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT lang, source, rid, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
s AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM s x JOIN s y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
term AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q) * (p - q) // q AS value FROM s JOIN l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 200
""",
    "op13_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
""",
}


def _documents(f: Callable[[DataFrame], DataFrame], table: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(load(spark, sf_dir, table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": _documents(op1_substring_dedup),
        "op2_near_dedup": _documents(op2_near_dedup),
        "op3_html_extract": _documents(op3_html_extract, "pages"),
        "op4_secret_scan": _documents(op4_secret_scan),
        "op5_quality": op5_quality,
        "op6_warc_zip": _documents(op6_warc_zip, "pages"),
        "op7_packing": _documents(op7_packing),
        "op8_order_minhash": _documents(op8_order_minhash),
        "op9_byte_bpe": _documents(op9_byte_bpe),
        "op10_top_k": _documents(op10_top_k, "embeddings"),
        "op11_prefix_trie": _documents(op11_prefix_trie, "conversations"),
        "op12_source_audit": _documents(op12_source_audit),
        "op13_ngram_join": _documents(op13_ngram_join),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
