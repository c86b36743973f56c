"""WARC derivative builder: metadata and plain-text conversion records from response records.

Each response gives one ``metadata`` record (its source headers, each outlink and the title as named fields) and
one ``conversion`` record (its plain text).  Both name the response in WARC-Refers-To and each other
in WARC-Concurrent-To (``linked_id``), so the three records form a closed set.  Record ids are derived from the response's
id, so a task that runs again makes the same records.  All of it is column expressions: no shuffle, no Python.

Null html counts as an empty payload with an empty text; a null url gives an empty target.  Repeated pages give repeated records with equal ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import prepare

#: Character references that the plain text resolves, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]
#: (pattern, replacement) in order; the syntax is common to Java's and RE2's engines.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|hr|main|form|dd|dt|dl|figure|body|html)\b[^>]*>"
RULES = [(HIDDEN, " "), (BREAKS, "\n"), (r"<[^>]*>", ""), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


#: The target of a link, without quotes; the syntax is common to both engines.
LINK = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']?([^"'\s>]*)"""


def plain_text(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, replacement in RULES[:3]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    for pattern, replacement in RULES[3:]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def record_id(*parts: Column) -> Column:
    """A urn:uuid from the md5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: id, record_id, target_uri, warc_date, http_headers, payload, payload_digest."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n")).alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: page_id, record_type, record_id, refers_to, linked_id, target_uri, warc_date, source_digest, content_type, block_digest, content_length, block."""
    meta_id, text_id = record_id(F.lit("metadata"), F.col("record_id")), record_id(F.lit("conversion"), F.col("record_id"))
    title = F.regexp_replace(F.regexp_extract("payload", r"(?is)<title\b[^>]*>(.*?)</title", 1), F.lit(r"\s+"), F.lit(" "))
    links = F.array_join(F.transform(F.regexp_extract_all("payload", F.lit(LINK), 1), lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")
    fields = F.concat(F.lit("sourceRecord: "), F.col("record_id"), F.lit("\r\nsourceDigest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), title, F.lit("\r\n"), links, F.col("http_headers"))
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), meta_id.alias("record_id"), text_id.alias("linked_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), text_id.alias("record_id"), meta_id.alias("linked_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("payload_digest").alias("source_digest"), F.explode(made).alias("r"))
    return out.select(
        "page_id", "r.record_type", "r.record_id", "refers_to", "r.linked_id", "target_uri", "warc_date", "source_digest", "r.content_type",
        digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), F.col("r.block").alias("block"),
    )


def serialise(records: DataFrame) -> DataFrame:
    """``records`` of derive() with a column ``warc``: the record's bytes as a WARC/1.1 file has them."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    bracket = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", bracket(F.col("record_id"))), line("WARC-Refers-To", bracket(F.col("refers_to"))), line("WARC-Concurrent-To", bracket(F.col("linked_id"))),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.withColumn("warc", F.concat(head.cast("binary"), F.col("block").cast("binary"), F.lit("\r\n\r\n").cast("binary")))


def parse(data: bytes) -> list[dict]:
    """Records of an uncompressed or gzipped WARC file: headers by lower-case name, and the block."""
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        out.append({"headers": headers, "block": data[stop + 4 : stop + 4 + size]})
        at = stop + 4 + size
    return out


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, in the shape of responses(), with the source's payload digest or one of the payload's bytes; a file is one task, as the format allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for r in parse(content):
                    if r["headers"].get("warc-type") == "response":
                        http, _, body = r["block"].partition(b"\r\n\r\n")
                        own = r["headers"].get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
                        rows.append((r["headers"].get("warc-record-id", "").strip("<>"), r["headers"].get("warc-target-uri", ""), r["headers"].get("warc-date", ""), http.decode("utf-8", "replace") + "\r\n", body.decode("utf-8", "replace"), own))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(6)], names=["record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest"])

    prepare(spark)
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string")
    return raw.select(F.col("record_id").alias("page_id"), "*")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in RULES[:3]:
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if to == chr(10) else quote(to)}, 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {quote(name)}, {quote(char)})"
    for pattern, to in RULES[3:]:
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(10)' if to == chr(10) else quote(to)}, 'g')"
    uuid = lambda h: f"'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h FROM pages),
r AS (SELECT *, {uuid("h")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest FROM p),
m AS (SELECT *, md5('metadata|' || refers_to) AS hm, md5('conversion|' || refers_to) AS hc FROM r),
b AS (SELECT page_id, 'metadata' AS record_type, {uuid("hm")} AS record_id, refers_to, {uuid("hc")} AS linked_id, target_uri, source_digest,
 'sourceRecord: ' || refers_to || {crlf} || 'sourceDigest: ' || source_digest || {crlf} || 'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title', 1), '\\s+', ' ', 'g') || {crlf}
 || array_to_string(list_transform(regexp_extract_all(payload, {quote(LINK)}, 1), lambda x: 'outlink: ' || x || {crlf}), '') || 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || CAST(strlen(payload) AS VARCHAR) || {crlf} AS block, 'application/warc-fields' AS content_type FROM m
UNION ALL SELECT page_id, 'conversion', {uuid("hc")}, refers_to, {uuid("hm")}, target_uri, source_digest, {text}, 'text/plain; charset=utf-8' FROM m)
SELECT page_id, record_type, record_id, refers_to, linked_id, target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type, block, source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM b
"""


ORACLE = _oracle()
