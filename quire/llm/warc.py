"""WARC derivative builder.

Responses become two linked records each: a `metadata` record (WARC fields: the
source's HTTP status and headers, its payload digest, its title and lengths)
and a `conversion` record (the plain text). Both carry WARC-Refers-To and the
target, date and digests of their source, as WARC 1.1 describes derivatives.

Everything is a narrow projection: no shuffle, no Python. Ids and digests are
functions of the content, so reruns and retried tasks write the same records.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURED = "2024-01-01T00:00:00Z"
CREATED = "2024-01-02T00:00:00Z"
DERIVED = ("warc_type", "record_id", "refers_to", "refers_to_target_uri", "refers_to_date", "source_digest", "source_headers", "content_type", "content_length", "block_digest", "block")
RESPONSE_COLUMNS = ("record_id", "target_uri", "warc_date", "http_status", "http_headers", "content_type", "body", "payload_digest")

# RE2 and java.util.regex read these alike.
INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>"
BLOCK = (
    r"(?i)<(?:/?(?:p|div|li|ul|ol|dl|dt|dd|tr|table|section|article|header|footer|nav|main|aside|h[1-6]|pre|blockquote|title|form|figure|figcaption|body|html)|br|hr)(?:\s[^>]*|/)?>"
)
TAG = r"<[A-Za-z/!?][^>]*>"
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#34;", '"'), ("&#160;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"), ("&amp;", "&"),
)
HORIZONTAL = r"[ \t\r\f\x{00A0}]+"
BREAKS = r" ?\n[ \n]*"


def html_text(html: Column) -> Column:
    """Visible text of a page: invisible elements go, block elements break
    lines, other tags vanish, named entities decode once (&amp; last), blanks
    collapse. Null stays null."""
    text = F.regexp_replace(html, INVISIBLE, "")
    text = F.regexp_replace(text, BLOCK, "\n")
    text = F.regexp_replace(text, TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, HORIZONTAL, " ")
    return F.btrim(F.regexp_replace(text, BREAKS, "\n"), F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """A name-based urn:uuid from the md5 of the parts (nulls count as empty)."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def page_responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Response records for rows of (page_id, url, html). A null html is an
    empty body; a null url a record without target. Repeated rows give repeated
    records with one id. Further columns are dropped."""
    body = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(captured).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK").alias("http_status"),
        F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string")).alias("http_headers"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        body.alias("body"),
        digest(body).alias("payload_digest"),
    )


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows a response: warc_type metadata and conversion.

    `responses` has RESPONSE_COLUMNS (others only pass through when named in
    `keep`). text/html is stripped, other text/* is taken as it is; any other
    type gets a metadata record only. Null bodies count as empty, null types as
    text/html. Of `keep`, names of the result and of RESPONSE_COLUMNS are left
    out. Repeated rows give repeated records, very long bodies are taken whole,
    an empty table gives an empty one. Of entities the named ones of ENTITIES
    and the numeric ones listed there are decoded.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in DERIVED and c not in RESPONSE_COLUMNS)
    kind = F.lower(F.coalesce("content_type", F.lit("text/html")))
    body = F.coalesce("body", F.lit(""))
    text = F.when(kind.startswith("text/html") | kind.startswith("application/xhtml"), html_text(body)).when(kind.startswith("text/"), body)
    title = F.btrim(F.regexp_replace(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"\s+", " "), F.lit(" "))
    base = responses.select(
        *keep, "record_id", "target_uri", "warc_date", "http_status", "http_headers", F.coalesce("payload_digest", digest(body)).alias("payload_digest"), F.octet_length(body).alias("body_bytes"), title.alias("title"), text.alias("text")
    )
    fields = F.concat(
        F.lit("via: "), F.coalesce("target_uri", F.lit("")), F.lit("\r\nhttp-status: "), F.coalesce("http_status", F.lit("")), F.lit("\r\n"), F.coalesce(F.concat("http_headers", F.lit("\r\n")), F.lit("")),
        F.lit("source-length: "), F.col("body_bytes").cast("string"), F.lit("\r\ntext-length: "), F.coalesce(F.octet_length("text"), F.lit(0)).cast("string"), F.lit("\r\ntitle: "), F.col("title"), F.lit("\r\n"),
    )
    meta = F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block"))
    conv = F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"))
    rows = base.select("*", F.explode(F.when(F.col("text").isNull(), F.array(meta)).otherwise(F.array(meta, conv))).alias("r"))
    return rows.select(
        *keep,
        "r.warc_type",
        urn(F.col("r.warc_type"), F.col("record_id"), F.col("payload_digest")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("warc_date").alias("refers_to_date"),
        F.col("payload_digest").alias("source_digest"),
        F.col("http_headers").alias("source_headers"),
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "r.block",
    )


def record_bytes(df: DataFrame, created: str = CREATED) -> DataFrame:
    """derivatives() rows as serialised WARC/1.1 records, in column `record`.

    WARC-Date is the derivative's own, `created`; what belongs to the source
    goes under names of its own: WARC-Refers-To, -Target-URI and -Date, and the
    extension fields X-Source-Payload-Digest and X-Source-Headers (base64, so
    that line breaks stay). Null fields are left out."""
    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("warc_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Date", F.lit(created)), header("WARC-Target-URI", F.col("refers_to_target_uri")),
        header("WARC-Refers-To", F.col("refers_to")), header("WARC-Refers-To-Target-URI", F.col("refers_to_target_uri")), header("WARC-Refers-To-Date", F.col("refers_to_date")), header("WARC-Block-Digest", F.col("block_digest")),
        header("X-Source-Payload-Digest", F.col("source_digest")), header("X-Source-Headers", F.replace(F.base64(F.encode("source_headers", "UTF-8")), F.lit("\r\n"), F.lit(""))), header("Content-Type", F.col("content_type")),
        header("Content-Length", F.col("content_length")), F.lit("\r\n"),
    )
    return df.withColumn("record", F.encode(F.concat(head, F.col("block"), F.lit("\r\n\r\n")), "UTF-8"))


def _at(path: str):
    """File system and path of a URI, or of a path in a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def write_warc(df: DataFrame, folder: str) -> DataFrame:
    """Write derivatives as one .warc.gz a task into a folder that all
    executors share (a URI, or a mounted path); returns (file, records). A file
    is named after its task and put in place by a rename, so a retried task
    replaces its own file. Null and empty blocks are records of length 0; an
    empty table gives files without records."""
    def write(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        where, root = _at(folder)
        where.create_dir(root, recursive=True)
        path, n = f"{root}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with where.open_output_stream(tmp, compression=None) as f:
            for batch in batches:
                for record in batch["record"]:
                    f.write(gzip.compress(bytes(record), 6, mtime=0))
                    n += 1
        where.move(tmp, path)
        yield pd.DataFrame({"file": [path], "records": [n]})

    return record_bytes(df).select("record").mapInPandas(write, "file string, records long")


def parse_warc(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from bytes or a stream of gzip
    members or plain records; one record is held at a time."""
    f = io.BufferedReader(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = gzip.open(f)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, f.read(int(headers["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under `path`: warc_type, headers, block. A
    task streams its files, however large; files without records give no rows."""
    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name in batch["path"]:
                where, at = _at(name)
                held, size = [], 0
                with where.open_input_stream(at, compression=None) as f:
                    for h, b in parse_warc(f):
                        held.append((h.get("WARC-Type"), h, b))
                        size += len(b)
                        if size > 8 << 20:
                            yield pd.DataFrame(held, columns=["warc_type", "headers", "block"])
                            held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["warc_type", "headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path").mapInPandas(parse, "warc_type string, headers map<string,string>, block binary")
