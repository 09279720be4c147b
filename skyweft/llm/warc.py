"""WARC archives kept as a table of record chunks.

A record is one or more rows (record, chunk): chunk 0 holds the record's headers
and the first payload bytes, later chunks hold further slices, and every row
carries the SHA-1 of the payload up to its end. Writer and reader touch one
slice at a time, so a payload of any size passes through without a second copy
of the whole record. Joining the ``data`` of a record in chunk order gives the
bytes of a WARC/1.1 record; joining records gives an archive.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with
the smallest page id is written as ``response``; the others become ``revisit``
records that hold only HTTP headers and name the response.

Records of several chunks lie in their own folder of the table. Only they are
brought together by record and sorted; all others are checked where they lie.

Defined cases: a null payload is empty; a null page id never wins over an id,
and rows that tie for the smallest id are all responses; a null URL is left out;
control characters in a URL are percent-encoded; an empty table gives no
records. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage

CHUNK_BYTES = 1 << 20
ROWS = "record bigint, chunk int, last boolean, payload_sha1 binary, data binary, oversized boolean"
PAGE = "urn:skyweft:page:"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def classify(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): refers_to is null for
    responses, whose payload is kept; a revisit keeps none."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"),
    )
    repeated = cut_lineage(
        rows.where(F.col("size") >= revisit_bytes)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n"),
        "payloads",
    )
    refers = F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()), F.col("first"))
    joined = rows.join(repeated, "digest", "left").withColumn("refers_to", refers)
    kept = F.when(F.col("refers_to").isNull(), F.col("html"))
    return joined.select("page_id", "url", kept.alias("html"), "digest", "size", "refers_to")


def _headers(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{name}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{PAGE}{refers_to}>",
        ]
    body = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {body}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(pages: DataFrame, target: str, revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html)."""

    def chunks(payload: memoryview, head: bytes) -> Iterator[tuple[int, bool, bytes, bytes]]:
        digest, number, at = hashlib.sha1(), 0, 0
        while True:
            piece = payload[at : at + chunk_bytes]
            at += len(piece)
            digest.update(piece)
            last = at >= len(payload)
            yield number, last, digest.digest(), b"".join([head if number == 0 else b"", piece, b"\r\n\r\n" if last else b""])
            number += 1
            if last:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 40
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.bool_()]
            names = ["record", "chunk", "last", "payload_sha1", "data", "oversized"]
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            ids, urls, html, digests, sizes, refers = batch.columns
            for i in range(batch.num_rows):
                body = html[i].as_buffer()
                head = _headers(ids[i].as_py(), urls[i].as_py(), digests[i].as_py(), sizes[i].as_py(), refers[i].as_py())
                for number, last, sha1, data in chunks(memoryview(body) if body is not None else memoryview(b""), head):
                    rows.append((record, number, last, sha1, data, number > 0 or not last))
                    held += len(data)
                    if held >= 4 * chunk_bytes:
                        held = 0
                        yield flush()
                record += 1
        if rows:
            yield flush()

    classify(pages, revisit_bytes).mapInArrow(run, ROWS).write.partitionBy("oversized").parquet(target)


class _Record:
    """Parses one record from its chunks, checking digests on the way."""

    def __init__(self) -> None:
        self.digest, self.length, self.left, self.fields, self.size = hashlib.sha1(), 0, 0, {}, 0

    def add(self, chunk: int, last: bool, sha1: bytes, data: memoryview) -> None:
        at = 0
        if chunk == 0:
            raw = bytes(data[: 1 << 16])
            head = raw.find(b"\r\n\r\n") + 4
            http = raw.find(b"\r\n\r\n", head) + 4
            if http < head:  # longer headers than usual
                raw = bytes(data)
                head = raw.find(b"\r\n\r\n") + 4
                http = raw.find(b"\r\n\r\n", head) + 4
            lines = raw[:head].decode().split("\r\n")
            self.fields = dict(line.split(": ", 1) for line in lines[1:] if line)
            self.size = int(re.search(rb"Content-Length: (\d+)", raw[head:http])[1])
            self.left = int(self.fields["Content-Length"]) - (http - head)
            at = http
        piece = data[at : at + self.left]
        self.digest.update(piece)
        self.left -= len(piece)
        self.length += len(piece)
        if self.digest.digest() != sha1:
            raise ValueError(f"chunk {chunk} of {self.fields.get('WARC-Record-ID')} is damaged")
        if last and (self.left or bytes(data[at + len(piece) :]) != b"\r\n\r\n"):
            raise ValueError(f"{self.fields.get('WARC-Record-ID')} has a wrong length")

    def row(self) -> tuple:
        page = self.fields["WARC-Record-ID"].strip("<>").removeprefix(PAGE)
        refers = self.fields.get("WARC-Refers-To", "").strip("<>").removeprefix(PAGE)
        digest = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = self.fields["WARC-Type"]
        if kind == "response" and (base64.b32encode(self.digest.digest()).decode() != digest or self.length != self.size):
            raise ValueError(f"the payload of page {page} does not have its digest")
        return int(page) if page else None, self.fields.get("WARC-Target-URI"), self.size, digest, kind, int(refers) if refers else None


def read_archives(spark: SparkSession, source: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of
    every record; a damaged or cut record raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        record = None
        for batch in batches:
            done = []
            for chunk, last, sha1, data in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                if chunk == 0:
                    if record is not None:
                        raise ValueError("a record has no last chunk")
                    record = _Record()
                record.add(chunk, last, sha1, memoryview(data.as_buffer()))
                if last:
                    done.append(record.row())
                    record = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    rows = spark.read.schema(ROWS).parquet(source)
    columns = ("chunk", "last", "payload_sha1", "data")
    small = rows.where(~F.col("oversized")).select(*columns)
    large = rows.where("oversized").repartition("record").sortWithinPartitions("record", "chunk").select(*columns)
    return small.mapInArrow(run, schema).unionByName(large.mapInArrow(run, schema))
