"""WARC records as a chunked table: written, deduplicated and read back as streams."""

from __future__ import annotations

import base64
import gzip
import hashlib

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import partitions, shared_path, stored, table

CHUNKS = "archive int, record long, chunk int, data binary, digest string"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string"
)
URN = "urn:framewise:page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
HEAD_STEP = 1 << 16


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_value(text: str) -> str:
    """Text as one header line: controls and line ends are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_head(kind: str, page: int | None, url: str | None, refers: int | None, size: int, digest: str, date: str) -> bytes:
    own = "" if page is None else page
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{own}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{URN}{refers}>")
    block = len(HTTP_HEAD) + (size if kind == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + END


def chunk_writer(chunk_bytes: int, date: str):
    """Rows (page, url, payload, refers) to chunk rows; no record is copied as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(CHUNKS)
        archive, record = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for page, url, payload, refers in zip(*[batch.column(i) for i in range(4)]):
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                body = memoryview(payload.as_buffer())
                digest = base32_sha1(hashlib.sha1(body).digest())
                kind = "response" if refers is None else "revisit"
                so_far = hashlib.sha1()
                head = record_head(kind, page, url, refers, len(body), digest, date) + HTTP_HEAD
                rows.append((archive, record, 0, head, base32_sha1(so_far.digest())))
                size = len(body) if kind == "response" else 0
                for no, at in enumerate(range(0, size, chunk_bytes), 1):
                    part = body[at : at + chunk_bytes]
                    so_far.update(part)
                    rows.append((archive, record, no, bytes(part), base32_sha1(so_far.copy().digest())))
                    held += len(part)
                    if held >= 8 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                rows.append((archive, record, -1, END, None))
                record += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


class RecordParser:
    """Takes the bytes of WARC records piece by piece; keeps heads and digests, never payloads."""

    def __init__(self) -> None:
        self.start()

    def start(self) -> None:
        self.buffer, self.stage = b"", "head"
        self.fields: dict[str, str] = {}
        self.left, self.size, self.sha = 0, 0, hashlib.sha1()

    def feed(self, data: bytes | memoryview) -> Iterator[tuple]:
        data = memoryview(data)
        while True:
            if self.stage == "head":
                taken = self._head(data, "WARC/")
                if taken is None:
                    return
                data = taken
                self.left = int(self.fields["content-length"])
                self.stage = "http" if "application/http" in self.fields.get("content-type", "") else "body"
            if self.stage == "http":
                seen = len(self.buffer)
                taken = self._head(data[: self.left - seen], None)
                if taken is None:
                    return
                used = len(data[: self.left - seen]) - len(taken)
                self.left -= seen + used
                data = data[used:]
                self.stage = "body"
            if self.stage == "body":
                part = data[: self.left]
                self.sha.update(part)
                self.size += len(part)
                self.left -= len(part)
                data = data[len(part) :]
                if self.left:
                    return
                self.stage = "end"
            if self.stage == "end":
                need = len(END) - len(self.buffer)
                self.buffer += bytes(data[:need])
                data = data[need:]
                if len(self.buffer) < len(END):
                    return
                if self.buffer != END:
                    raise ValueError(f"record {self.fields} does not end in two line ends")
                row = self.row()
                self.start()
                if row:
                    yield row

    def _head(self, data: memoryview, first: str | None) -> memoryview | None:
        """Collect a head up to its empty line; what follows, or None while it is incomplete."""
        before, taken, at = len(self.buffer), 0, -1
        while at < 0 and taken < len(data):
            step = bytes(data[taken : taken + HEAD_STEP])
            taken += len(step)
            self.buffer += step
            at = self.buffer.find(END, max(0, len(self.buffer) - len(step) - len(END) + 1))
        if at < 0:
            return None
        if first:
            lines = self.buffer[:at].decode().split("\r\n")
            if not lines[0].startswith(first):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.buffer = b""
        return data[at + len(END) - before :]

    def row(self) -> tuple | None:
        f = self.fields
        kind = f.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        digest, size = base32_sha1(self.sha.digest()), self.size
        told = f.get("warc-payload-digest", "").rpartition(":")[2]
        if kind == "revisit":
            digest, size = told, int(f.get("x-payload-length", 0))
        elif told and told != digest:
            raise ValueError(f"payload of {f.get('warc-record-id')} has digest {digest}, not {told}")

        def page(name: str) -> int | None:
            text = f.get(name, "").strip("<>").removeprefix(URN)
            return int(text) if text.lstrip("-").isdigit() else None

        return (page("warc-record-id"), f.get("warc-target-uri"), kind, page("warc-refers-to"), size, digest)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(RECORDS)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows in order of (archive, record, chunk) to one row a record."""
    parser, now = RecordParser(), None
    for batch in batches:
        rows = []
        for archive, record, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (archive, record) != now:
                if parser.stage != "head" or parser.buffer:
                    raise ValueError(f"record {now} is cut short")
                now = (archive, record)
            rows.extend(parser.feed(data.as_buffer()))
        yield _to_batch(rows)
    if parser.stage != "head" or parser.buffer:
        raise ValueError(f"record {now} is cut short")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    chunk_bytes: int = 1 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC record a row as a chunk table below ``path``.

    A row holds ``archive, record, chunk, data, digest``: the bytes of a record in pieces of at
    most ``chunk_bytes`` (chunk 0 is its head, chunk -1 its end) and the SHA-1 of the payload up to
    and with that piece.  The pieces in order are WARC/1.1.  Of equal payloads of ``min_bytes`` or
    more, the smallest id is a ``response`` and the others are a ``revisit`` that refers to it.

    Defined cases: NULL payload is empty; an id of NULL is never referred to unless no other row
    has the payload, when all are responses; rows that repeat the smallest id are all responses;
    controls in a URL are percent-encoded.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
        payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("sha"),
    )
    firsts = stored(
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select("sha", "first"),
        "payloads",
    )
    refers = F.when(F.octet_length("payload") >= min_bytes, F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")))
    marked = rows.join(firsts, "sha", "left").select("page", "url", "payload", refers.alias("refers"))
    marked.mapInArrow(chunk_writer(chunk_bytes, date), CHUNKS).write.parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of a chunk table: id, url, type, reference, payload length and digest.

    The chunks of a record meet in one task in order and pass one at a time through a digest; the
    digest in the head is checked.  A record that lacks pieces is an error.
    """
    order = F.when(F.col("chunk") < 0, F.lit(2**31 - 1)).otherwise(F.col("chunk")).alias("chunk")
    chunks = spark.read.schema(CHUNKS).parquet(path).select("archive", "record", order, "data")
    return (
        chunks.repartition(partitions(spark), "archive", "record")
        .sortWithinPartitions("archive", "record", "chunk")
        .select("archive", "record", "data")
        .mapInArrow(read_chunks, RECORDS)
    )


def read_warc_files(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """The records of ``.warc`` and ``.warc.gz`` files, a file being the unit of work.

    Spark's ``binaryFile`` source bounds a file to 2 GB; larger ones must be written as chunk tables.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = pa.BufferReader(content.as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = gzip.GzipFile(fileobj=raw) if packed else raw
                parser, rows = RecordParser(), []
                while data := stream.read(piece):
                    rows.extend(parser.feed(data))
                yield _to_batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(parse, RECORDS)


def warc_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of each archive in order, for export: ``archive, place, data``."""
    order = F.when(F.col("chunk") < 0, F.lit(2**31 - 1)).otherwise(F.col("chunk"))
    return spark.read.schema(CHUNKS).parquet(path).select(
        "archive", F.struct("record", order.alias("chunk")).alias("place"), "data"
    )


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path, min_bytes=0)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + CAST((('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31 AS INTEGER), 1)"
    for g in range(8) for k in range(4)
)
OP9_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT body, min(page_id) AS first FROM payloads GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN firsts USING (body)
"""
