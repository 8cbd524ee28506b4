"""WARC archives: one gzip member per record, written by Spark and read back sequentially.

Writing: of records with equal payloads of at least 100 bytes the one with the smallest page id is the response and the
others revisit it, which one aggregate over digests decides. A task turns its rows into gzip members and Spark's own text
writer puts them into files, so the archives may lie in any store that Spark can write, and a task that is run again
replaces its file. A gzip member ends in the top byte of its length; the writer's line separator is that zero byte, so a
file is exactly its members, one after the other. A task begins a new archive after ``ARCHIVE_BYTES`` of members, so an
archive is never larger than that and one record.

Reading: Spark hands a task whole archives, which the bound on their bytes keeps small; the task takes one, feeds it to an incremental zlib decompressor member by member, frames the record by
Content-Length and verifies block and payload digests; anything that does not fit raises ValueError.

Defined cases: a null payload is an empty one; a null url leaves out the target URI; control characters in a url are
percent-encoded. Null page ids come after all others. Rows that repeat the smallest id of a group are all responses.
An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselane.llm.rows import objects
from caselane.session import scratch_path, written

LEAST = 100  # bytes from which on equal payloads are stored once
ARCHIVE_BYTES = 1 << 26  # compressed bytes after which a task begins a new archive
BATCH_BYTES = 1 << 23  # bytes of members or records that a task hands on at a time
DATE = "2024-01-01T00:00:00Z"  # capture time of the records, a parameter of the archive
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def record(page_id, url, payload: bytes, size: int, digest: str, first, date: str) -> bytes:
    """One uncompressed record; ``first`` is the id of the response that a revisit refers to, or None."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(chr(c) for c in range(33, 127) if c != 37)) if re.search(r"[\x00-\x20%\x7f-￿]", url) else url))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in fields]]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is the zero that the writer puts between rows."""
    packed = zlib.compress(data, 6, wbits=31)
    return (packed if packed[-1] == 0 else packed + EMPTY_MEMBER)[:-1]


def members(archive: bytes | pa.Buffer, piece: int = 1 << 16) -> Iterator[bytes]:
    """The contents of an archive's gzip members, decompressed a piece of input at a time."""
    view, at = memoryview(archive), 0
    while at < len(view):
        engine, parts = zlib.decompressobj(wbits=31), []
        while not engine.eof:
            if at >= len(view):
                raise ValueError("archive ends within a member")
            fed = view[at:at + piece]
            parts.append(engine.decompress(fed))
            at += len(fed) - len(engine.unused_data)
        if data := b"".join(parts):
            yield data


def parse(data: bytes) -> dict:
    """The fields, size, digest and payload of one record, verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no record header")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: content length does not frame the record")
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"]:
        raise ValueError(f"{fields['warc-record-id']}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: payload digest differs")
    ident = lambda name: None if (v := fields[name][len("<urn:page:"):-1]) == "None" else int(v)
    url = fields.get("warc-target-uri")
    return {"page_id": ident("warc-record-id"), "url": unquote(url) if url is not None and "%" in url else url, "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": ident("warc-refers-to") if revisit else None,
            "html": None if revisit else payload.decode()}


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, size, digest and the id of the response that the row revisits, if it does."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
                        F.sha2(payload, 256).alias("digest"))
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    repeated = written(rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n"))
                       .filter("n > 1").select("digest", F.col("least.page_id").alias("first")), "payloads")
    joined = rows.join(repeated, "digest", "left")
    return joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every page as one record into archives of bounded size below ``folder``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = filled = 0
        for batch in batches:
            found, numbers, size = [], [], 0
            for row in zip(*(objects(batch.column(c)) for c in ("page_id", "url", "payload", "size", "digest", "first"))):
                data = member(record(*row, date))
                if filled >= archive_bytes:
                    number, filled = number + 1, 0
                filled += len(data) + 1
                size += len(data)
                found.append(data)
                numbers.append(number)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(numbers, pa.int32())], ["member", "archive"])
                    found, numbers, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(numbers, pa.int32())], ["member", "archive"])

    packed = plan(pages, least).mapInArrow(pack, "member binary, archive int")
    (packed.select(F.col("member").cast("string").alias("value"), "archive").write.partitionBy("archive")
     .option("lineSep", "\x00").option("compression", "none").text(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below ``folder``; of revisits without payload."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for data in members(archive.as_buffer()):
                    rows.append(parse(data))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    archives = spark.read.format("binaryFile").load(folder).select("content")
    return archives.mapInArrow(unpack, RESULT)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def report(pages: DataFrame) -> DataFrame:
    """Write the pages into archives in the shared folder, then read these."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    write(pages, folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH rows AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""
