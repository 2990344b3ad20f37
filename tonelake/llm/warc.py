"""WARC records, and the assembly of captures from them.

``read_warc`` parses .warc and .warc.gz files; ``parse_records`` parses records that are strings. Either gives rows (record_id, type, target_uri,
date, concurrent_to, headers, payload). ``assemble`` joins request, response and metadata records through their concurrent-to identifiers: a
capture is a connected component of the records under "names as concurrent", in either direction and over any number of steps (metadata may
name the request, and the request the response). One nested row comes out for each capture. The payloads are shuffled once.

Cases: a record that names no other, and is named by none, is a capture of its own; so is one without an identifier, which gets one from a hash
of its content. A name of a record that isn't there still joins the records that share it. Repeated records (equal in all parsed parts) count
once; different records with one identifier all stay, in order of their content. Header names are matched in any case; the first target URI, date
and type count, all concurrent-to headers do. A record without an end of header has no payload; without a type, or of a type besides request, response and
metadata (revisit counts as response), it goes to ``others``. Null rows are skipped. An empty table gives an empty result. A payload may be of any length that a Spark string holds; ``read_warc`` reads a file as one value, so a file is
2 GB at most. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components

RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, headers string, payload string"


def _header(block: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(block, rf"(?im)^{name}[ \t]*:([^\r\n]*)", 1))
    return F.when(found != "", found)


def parse_records(records: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed rows of a column of whole records (header block, blank line, payload), all in the JVM. keep: columns that belong to the payload and stay."""
    x = F.col(raw)
    end = F.instr(x, "\r\n\r\n")
    rows = records.where(x.isNotNull()).select(F.when(end > 0, F.substring(x, F.lit(1), end - 1)).otherwise(x).alias("headers"), F.when(end > 0, F.substring(x, end + 4, F.length(x))).alias("payload"), *keep)
    h = F.col("headers")
    named = F.transform(F.regexp_extract_all(h, F.lit(r"(?im)^WARC-Concurrent-To[ \t]*:([^\r\n]*)"), F.lit(1)), lambda v: F.trim(v))
    return rows.select(
        F.coalesce(_header(h, "WARC-Record-ID"), F.concat(F.lit("<hash:"), F.hex(F.xxhash64("headers", "payload", *keep)), F.lit(">"))).alias("record_id"),
        F.lower(_header(h, "WARC-Type")).alias("type"), _header(h, "WARC-Target-URI").alias("target_uri"), _header(h, "WARC-Date").alias("date"),
        F.array_distinct(F.filter(named, lambda v: v != "")).alias("concurrent_to"), "headers", "payload", *keep,
    )


def split_stream(data: bytes) -> Iterator[bytes]:
    """The raw records of a file's bytes, by their Content-Length; gzip members are unpacked. A cut last record is given as far as it goes."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))  # type: ignore[arg-type]
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        head, size = [line], 0
        while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
            head.append(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        yield b"".join(head) + b"\r\n" + stream.read(size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows of WARC files, and ``payload_bytes``; a file is read by one task, as gzip members can't be found from the middle.

    A payload that isn't UTF-8 is whole in payload_bytes, and payload is what can be read of it as text; of other payloads, payload_bytes is null."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def batch_of(block: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
        raw, whole = zip(*block, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(raw, pa.string()), pa.array(whole, pa.binary())], names=["raw", "payload_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                block, size = [], 0
                for record in split_stream(content.as_py()):
                    head, end, payload = record.partition(b"\r\n\r\n")
                    try:
                        text, whole = payload.decode(), None
                    except UnicodeDecodeError:
                        text, whole = payload.decode("utf-8", "replace"), payload
                    block.append((head.decode("utf-8", "backslashreplace") + end.decode() + text, whole))
                    size += len(record)
                    if size > 4 << 20:
                        yield batch_of(block)
                        block, size = [], 0
                if block:
                    yield batch_of(block)

    return parse_records(files.mapInArrow(run, "raw string, payload_bytes binary"), keep=("payload_bytes",))


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, target_uri, date, requests, responses, metadata, others) of parsed rows; each list is of struct(record_id, headers, payload), by record_id,
    with payload_bytes if the rows have it (``read_warc``).

    capture_id is the least record_id of the responses, or if there is none of all records; target_uri and date are that record's.
    """
    node = lambda c: F.xxhash64(c)
    edges = records.select(node("record_id").alias("a"), F.explode("concurrent_to").alias("to")).select("a", node("to").alias("b"))
    roots = connected_components(edges)
    kept = ["payload_bytes"] if "payload_bytes" in records.columns else []
    rows = records.select(node("record_id").alias("node"), *(F.col(c) for c in ("record_id", "type", "target_uri", "date", "headers", "payload", *kept)))
    own = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    part = F.struct("record_id", "headers", "payload", *kept)
    kind = F.when(F.col("type").isin("request", "metadata"), F.col("type")).when(F.col("type").isin("response", "revisit"), "response").otherwise("other")
    each = own.select("root", kind.alias("kind"), F.struct((kind != "response").alias("rank"), "record_id", "target_uri", "date").alias("head"), part.alias("part"))
    take = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("part"))))
    # gathered unmerged: payloads go through one shuffle, to the task that builds the row
    out = each.groupBy("root").agg(F.min("head").alias("head"), *(take(k).alias(n) for k, n in (("request", "requests"), ("response", "responses"), ("metadata", "metadata"), ("other", "others"))))
    return out.select(F.col("head.record_id").alias("capture_id"), "head.target_uri", "head.date", "requests", "responses", "metadata", "others")


def records_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(raw): three WARC records for each page, as a crawler writes them: the response, its request, and metadata that names the request.

    A null id, url or html is written as an empty string."""
    i, u, body = F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit(""))
    name = lambda kind: F.concat(F.lit(f"<urn:page:{kind}:"), i, F.lit(">"))

    def record(kind: str, concurrent: str | None, mime: str, content: Column) -> Column:
        lines = [F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), name(kind), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), u)]
        if concurrent:
            lines.append(F.concat(F.lit("\r\nWARC-Concurrent-To: "), name(concurrent)))
        lines.append(F.concat(F.lit(f"\r\nContent-Type: {mime}\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content))
        return F.concat(*lines)

    host, rest = F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1), F.regexp_replace(u, r"^[a-z]+://[^/?#]*|#.*$", "")
    request = F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    meta = F.concat(F.lit("fetchTimeMs: "), F.pmod(F.xxhash64(u), F.lit(500)).cast("string"), F.lit("\r\n"))
    return pages.select(F.explode(F.array(
        record("response", None, "application/http;msgtype=response", response), record("request", "response", "application/http;msgtype=request", request), record("metadata", "request", "application/warc-fields", meta),
    )).alias("raw"))


def capture_summary(captures: DataFrame) -> DataFrame:
    """A flat row for each capture: its numbers of records, and the status, length and SHA-256 of its first response's body."""
    payload = F.col("responses")[0]["payload"]
    body = F.substring(payload, F.instr(payload, "\r\n\r\n") + 4, F.length(payload))
    return captures.select(
        "capture_id", "target_uri", F.size("requests").alias("n_requests"), F.size("responses").alias("n_responses"), F.size("metadata").alias("n_metadata"),
        F.regexp_extract(payload, r"^HTTP/\S+ (\d+)", 1).cast("int").alias("status"), F.length(body).alias("body_chars"), F.sha2(body, 256).alias("body_sha256"),
        F.split_part(F.col("requests")[0]["payload"], F.lit(" "), F.lit(2)).alias("path"),
    )
