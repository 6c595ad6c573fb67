"""WARC archives: writing, reading, and revisit records for equal payloads.

Records are written through Spark's text files, one row a record, and read back as whole files by
their Content-Length, so that payloads may hold anything. A file has at most FILE_RECORDS records.

`resolve` moves headers only: for each payload digest the smallest page is the response, and the other records of it
revisit that one. `deduplicate` writes new archives: responses keep their payload, revisits have
none, and all get fresh headers that name what they refer to.

Cases: a null payload is empty; a null url is an empty target; payloads under `least` bytes are all
responses; rows of one page_id are records each, all responses if that page is the first of its payload; a record
without page_id is always a response; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, staged

FILE_RECORDS = 1500
#: Payloads under this size are not worth a reference.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"

RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def _lines(*lines: Column) -> Column:
    """Header lines; null ones are left out."""
    return F.concat_ws("\r\n", *lines)


def _head(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _one_line(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " ")


def record_text(page_id: Column, url: Column, payload: Column, refers_to: Column, size: Column, digest: Column) -> Column:
    """A record but for its last line feed. refers_to: null for a response."""
    revisit = refers_to.isNotNull()
    name = lambda p: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("none")), F.lit(">"))
    head = _lines(
        F.lit("WARC/1.1"),
        _head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _head("WARC-Record-ID", name(page_id)),
        _head("WARC-Target-URI", _one_line(url)),
        _head("WARC-Date", F.lit(DATE)),
        F.when(revisit, _head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, _head("WARC-Refers-To", name(refers_to))),
        _head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _head("X-Payload-Length", size.cast("string")),
        _head("Content-Type", F.lit("text/html; charset=utf-8")),
        _head("Content-Length", F.when(revisit, "0").otherwise(size.cast("string"))),
    )
    return F.concat(head, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(payload), F.lit("\r\n\r"))


def write_archive(records: DataFrame, path: str) -> None:
    """records: page_id, url, payload, refers_to, payload_bytes, payload_digest."""
    c = F.col
    text = record_text(c("page_id"), c("url"), c("payload"), c("refers_to"), c("payload_bytes"), c("payload_digest"))
    records.select(text.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parse(data: bytes, payloads: bool):
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = dict(x.partition(b": ")[::2] for x in data[at:end].split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        body = data[end + 4 : end + 4 + size]
        kind = head[b"WARC-Type"].decode()
        page, refers = (re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(k, b"")) for k in (b"WARC-Record-ID", b"WARC-Refers-To"))
        full = kind == "response"
        yield (
            int(page[1]) if page else None,
            head.get(b"WARC-Target-URI", b"").decode(),
            kind,
            int(refers[1]) if refers else None,
            len(body) if full else int(head[b"X-Payload-Length"]),
            hashlib.sha256(body).hexdigest() if full else head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"),
            body.decode() if payloads else None,
        )
        at = end + 4 + size + 4


def _records(payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        import zlib

        for b in batches:
            for content in b.column(0):
                data = zlib.decompress(content.as_buffer(), 31) if len(content.as_buffer()) else b""
                rows = list(_parse(data, payloads))
                for cut in range(0, len(rows), 500):
                    columns = list(zip(*rows[cut : cut + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The archive's records (see RECORD); digests of responses are taken from the payload, not the header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records(payloads), RECORD)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """payload_digest, first: of each digest that several records of `least` bytes or more have, the smallest page_id."""
    worth = headers.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    return worth.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")


def deduplicate(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The headers (RECORD) read from the new archives, for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    first, second = new_path(spark, "warc"), new_path(spark, "warc-deduplicated")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.lit(None).cast("bigint").alias("refers_to"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    write_archive(rows, first)
    headers = staged(read_archive(spark, first).select("page_id", "payload_bytes", "payload_digest"), "warc-headers")
    originals = small(staged(resolve(headers, least), "warc-originals"))
    known = read_archive(spark, first, payloads=True).drop("refers_to")
    same = (known["payload_digest"] == originals["payload_digest"]) & (known["payload_bytes"] >= least)
    judged = known.join(originals, same, "left").drop(originals["payload_digest"])
    refers = F.when((F.col("first") != F.col("page_id")) & (F.col("payload_bytes") >= least), F.col("first"))
    write_archive(judged.withColumn("refers_to", refers), second)
    return read_archive(spark, second)
