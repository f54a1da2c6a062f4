"""SQL of the registered queries, for the operators that SQL can express."""

from __future__ import annotations

from . import warc


def _warc() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(html, {q(warc.INVISIBLE)}, '', 'g')"
    text = f"regexp_replace({text}, {q(warc.BLOCK)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {q(warc.TAG)}, '', 'g')"
    for name, char in warc.ENTITIES:
        text = f"replace({text}, {q(name)}, {q(char)})"
    text = f"regexp_replace({text}, {q(warc.HORIZONTAL)}, ' ', 'g')"
    text = f"trim(regexp_replace({text}, {q(warc.BREAKS)}, chr(10), 'g'), ' ' || chr(10))"
    urn = lambda *p: "(SELECT concat('<urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32], '>') FROM (SELECT md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({x} AS VARCHAR), '')" for x in p) + ")) AS h))"
    eol = "chr(13) || chr(10)"
    fields = f"""'via: ' || coalesce(url, '') || {eol} || 'http-status: HTTP/1.1 200 OK' || {eol} || source_headers || {eol} || 'source-length: ' || body_bytes || {eol} || 'text-length: ' || strlen(text) || {eol} || 'title: ' || title || {eol}"""
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, url, {urn("'response'", 'page_id', 'url')} AS refers_to, strlen(html) AS body_bytes, 'sha256:' || sha256(html) AS source_digest, 'Content-Type: text/html; charset=utf-8' || {eol} || 'Content-Length: ' || strlen(html) AS source_headers,
 trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g'), ' ') AS title, {text} AS text FROM p),
r AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {fields} AS block FROM b UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM b)
SELECT page_id, warc_type, {urn('warc_type', 'refers_to', 'source_digest')} AS record_id, refers_to, url AS refers_to_target_uri, '{warc.CAPTURED}' AS refers_to_date, source_digest, source_headers, content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block FROM r"""


_ASCII = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"""WITH s AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row_id, doc_id, CAST(i AS BIGINT) AS i, lines[i] AS line, translate(trim(lines[i], {_ASCII}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s)),
rep AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_id) >= 3),
m AS (SELECT l.*, rep.last IS NOT NULL AND l.doc_id < rep.last AS gone FROM l LEFT JOIN rep USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY row_id, doc_id"""

TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""

SQL = {"op1_warc_derivatives": _warc(), "op6_dual_tree": TOP, "op8_line_dedup": LINES, "line_index_incremental": LINES}
