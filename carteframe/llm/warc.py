"""WARC archives: writing captures with revisit records, reading records, assembling transactions.

Spark's text writer makes the archives (each row is the records of one capture, the row end is the record end), so that
lost tasks leave nothing behind and any store that Spark can write will do; a file is one gzip stream of some FILE_BYTES.
Reading streams through each file, cuts records by Content-Length, and computes a response's digest from its payload.

Defined cases: ids are integers, others are refused; a null or empty payload is a payload of 0 bytes; a null url leaves its header out; line breaks in a url
are percent-encoded; repeated rows are captures of their own; an empty table gives no archive and no capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_ids, map_arrow, materialize

#: Captures of one file, at most; bytes of payload in one file, about.
FILE_CAPTURES, FILE_BYTES = 20_000, 64_000_000
#: Payloads of at least so many bytes are recorded once; later ones revisit the first.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

RECORD = "record_id string, type string, concurrent_to string, uri string, digest string, payload string, payload_bytes long, page_id long, refers_to long, verified boolean"


def base32_sha1(payload: Column) -> Column:
    """Base32 of SHA-1: each 5 hexadecimal digits are 4 digits of base 32."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, date: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}")]
    for name, value in headers:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """Three records a capture: request, response or revisit, metadata; request and metadata name the second in
    WARC-Concurrent-To, a revisit names its response's target and date. date: of the capture, as in ISO 8601."""
    integer_ids(pages, id_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("url", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"))
    seen = materialize(rows.select("page", "url", base32_sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes")), "payloads")
    total = seen.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    captures = max(1, min(FILE_CAPTURES, int(FILE_BYTES * total["n"] / max(1, total["b"] or 0))))
    first = seen.where((F.col("bytes") >= least_bytes) & F.col("page").isNotNull()).groupBy("digest", "bytes").agg(F.min("page").alias("first"), F.min_by("url", "page").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first", "first_url"), "payloads-first")
    revisits = seen.join(first, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes"))).where("page != first")
    revisits = materialize(revisits.select(F.col("page").alias("_page"), F.col("digest").alias("_digest"), "first", "first_url").distinct(), "revisits")
    rows = rows.withColumn("digest", base32_sha1("html")).join(revisits, (F.col("page") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull()
    one = F.md5(F.concat_ws("|", F.col("page").cast("string"), "digest", F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("one", one)
    name = lambda kind: F.concat(F.lit(f"urn:capture:{kind}:"), F.col("one"))
    target, with_ = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.concat(F.lit("<"), name("response"), F.lit(">")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    fields = F.concat(F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit(CRLF), *(F.coalesce(F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit(CRLF)), F.lit("")) for n, c in (("page-id", "page"), ("refers-to-page", "first"))))
    request = _record("request", date, name("request"), [target, with_, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF + CRLF}")))
    profile = F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    origin = [("WARC-Refers-To-Target-URI", F.when(again, F.col("first_url"))), ("WARC-Refers-To-Date", F.when(again, F.lit(date)))]
    response = _record(F.when(again, "revisit").otherwise("response"), date, name("response"), [target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", profile), *origin, ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(again, http).otherwise(F.concat(http, "html")))
    metadata = _record("metadata", date, name("metadata"), [target, with_, ("Content-Type", F.lit("application/warc-fields"))], fields)
    end = F.lit(CRLF + CRLF)
    out = rows.select(F.concat(request, end, response, end, metadata).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


class _Stream:
    """Reads a gzip stream (of one or more members) or plain bytes piece by piece."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at, self.held = data, 0, bytearray()
        self.gz = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if self.gz is None:
            self.held += part
            return True
        self.held += self.gz.decompress(part)
        while self.gz.eof and self.gz.unused_data:
            rest = self.gz.unused_data
            self.gz = zlib.decompressobj(31)
            self.held += self.gz.decompress(rest)
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _named(lines: bytes) -> dict[str, str]:
    return {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines.decode("utf-8", "replace").split(CRLF)) if _}


def parse_records(data: memoryview, payloads: bool) -> Iterator[dict]:
    """Records of one archive file; a response's payload is checked against its digest."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        headers = _named(head.lstrip(b"\r\n"))
        block = stream.take(int(headers["content-length"]))
        stream.take(4)
        kind, plain = headers.get("warc-type", ""), lambda v: v.strip("<>") if v else None
        out = {"record_id": plain(headers.get("warc-record-id")), "type": kind, "concurrent_to": plain(headers.get("warc-concurrent-to")), "uri": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if kind == "response" and b"\r\n\r\n" in block:
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out |= {"payload_bytes": len(payload), "digest": digest, "verified": digest == out["digest"]}
            if payloads:
                out["payload"] = payload.decode("utf-8", "replace")
        elif kind == "metadata":
            fields = _named(block)
            out |= {k: int(fields[n]) for k, n in (("payload_bytes", "payload-bytes"), ("page_id", "page-id"), ("refers_to", "refers-to-page")) if n in fields}
        yield out


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = spark.createDataFrame([], RECORD).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                for row in parse_records(memoryview(value.as_buffer()), payloads):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or "")
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return map_arrow(files, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, uri, request, response (or revisit) and metadata records that name it in WARC-Concurrent-To."""
    capture = F.coalesce("concurrent_to", "record_id")
    part = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), F.struct(*(c for c in records.columns if c != "concurrent_to"))), ignorenulls=True)
    return records.groupBy(capture.alias("capture_id")).agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata")).where("response is not null").withColumn("uri", F.col("response.uri"))
