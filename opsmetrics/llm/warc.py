"""WARC archives as a chunked record table.

Payloads travel as (record id, chunk number) rows of at most `CHUNK` bytes, in order inside a
partition. The writer takes them one by one into gzip members, the reader streams an archive and
gives the same rows back, each with the SHA-256 of the payload up to there. Neither ever holds a
payload as one piece.

Archives are written by the tasks through `pyarrow.fs`, so the folder is any store it knows by URI
(file, s3, gs, hdfs, ...). A task writes under a name of its own attempt and returns it; only names
that came back are read, so retries and lost executors leave no doubled record.

Defined results: a null payload is empty; a record without id is a response and refers to nothing;
of records that repeat the id and the payload of the first all are responses; an empty table gives
no archives and no rows. Only id, URI and payload are read; control characters and blanks of a URI
are percent-encoded, a null URI is left out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.session import ship_package, stage, work_path

CHUNK = 1 << 16
SHORTEST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, ID_SUFFIX = "<urn:record:", ">"

MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "record_id long, record_type string, uri string, refers_to long, chunk int, offset long, "
    "data binary, digest string, is_last boolean")
_CHUNK_TYPES = pa.schema([
    ("record_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.int64()),
    ("chunk", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()),
    ("is_last", pa.bool_()),
])


def records(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    shortest: int = SHORTEST_REVISIT,
) -> DataFrame:
    """id, uri, payload, digest, size, record_type, refers_to: of equal payloads of at least
    `shortest` bytes the smallest id is the response, the others revisit it.

    Equal payloads are found on narrow (id, digest) rows; only the revisits among them, by id, go
    back to the wide rows.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    narrow = stage(base.where(F.col("size") >= shortest).select("id", "digest"), "payload-digests")
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = narrow.join(firsts.select("digest", "refers_to"), "digest").where(F.col("id") > F.col("refers_to")) \
        .select("id", "digest", "refers_to").distinct()
    return base.join(again, ["id", "digest"], "left").withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def chunk_rows(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows the writer takes: chunk 0 always, more for a long payload; a revisit has no data."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("body").cast("long") - 1, F.lit(0)), F.lit(chunk).cast("long"))
    return recs.withColumn("body", body).select(
        "id", "uri", "digest", "size", "record_type", "refers_to", "body", F.posexplode(starts).alias("chunk", "at")
    ).select(
        "id", "uri", "digest", "size", "record_type", "refers_to", "chunk",
        F.substring("body", F.col("at").cast("int") + 1, F.lit(chunk)).alias("data"))


def _urn(record_id: int | None) -> str:
    return f"{ID_PREFIX}{'' if record_id is None else record_id}{ID_SUFFIX}"


def _record_id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix(ID_PREFIX).removesuffix(ID_SUFFIX)
    return int(number) if number else None


def _head(row: dict) -> bytes:
    """All of a record before its payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['size']}\r\n\r\n").encode()
    revisit = row["record_type"] == "revisit"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["id"])), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
    ]
    if row["uri"] is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["uri"])))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(row["refers_to"]))]
    fields += [
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else row["size"])))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8") + http


class _Archive:
    """One file of gzip members, a record each."""

    def __init__(self, folder: str, level: int):
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.warc.gz"
        self.path, self.level, self.records, self.bytes = f"{folder}/{name}", level, 0, 0
        self._out, self._member = store.open_output_stream(f"{place}/{name}", compression=None), None

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def begin(self, head: bytes) -> None:
        self.end()
        self._member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.records += 1
        self.add(head)

    def add(self, data: bytes | pa.Buffer) -> None:
        self._put(self._member.compress(data))

    def end(self) -> None:
        if self._member:
            self.add(b"\r\n\r\n")
            self._put(self._member.flush())
            self._member = None

    def close(self) -> None:
        self.end()
        self._out.close()


def write_archives(
    chunks: DataFrame, folder: str | None = None, level: int = 1, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write the records of `chunk_rows` below `folder`; returns the manifest, a written table."""
    ship_package(chunks.sparkSession)
    folder = folder or work_path(chunks.sparkSession, "warc")
    meta = ("id", "uri", "digest", "size", "record_type", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            data, numbers = batch.column("data"), batch.column("chunk").to_pylist()
            rows = batch.select(meta).to_pylist()
            for i, n in enumerate(numbers):
                if n == 0:
                    if archive and archive.bytes >= archive_bytes:
                        archive.close()
                        done.append(archive)
                        archive = None
                    archive = archive or _Archive(folder, level)
                    archive.begin(_head(rows[i]))
                archive.add(data[i].as_buffer())
        if archive:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()),
             pa.array([a.bytes for a in done], pa.int64())], names=["path", "records", "bytes"])

    return stage(chunks.mapInArrow(write, MANIFEST), "warc-manifest")


def _fields(stream: BinaryIO) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, and their length."""
    found, size = {}, 0
    while (line := stream.readline()) not in (b"\r\n", b""):
        size += len(line)
        name, colon, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
        if colon:
            found[name] = value
    return found, size + len(line)


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of `CHUNKS` from one uncompressed archive stream, in order.

    Raises ValueError where a payload is cut short or does not have its digest.
    """
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record where one was expected: {version[:40]!r}")
        head, _ = _fields(stream)
        http, http_size = _fields(stream)
        kind, declared = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        meta = (_record_id(head["WARC-Record-ID"]), kind, head.get("WARC-Target-URI"), _record_id(head.get("WARC-Refers-To")))
        left = int(head["Content-Length"]) - http_size
        if kind == "revisit":
            yield *meta, 0, int(http["Content-Length"]), b"", declared, True
        else:
            running, number, offset = hashlib.sha256(), 0, 0
            while True:
                data = stream.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"record {meta[0]} ends early")
                running.update(data)
                left -= len(data)
                if not left and running.hexdigest() != declared:
                    raise ValueError(f"record {meta[0]} does not have its digest")
                yield *meta, number, offset, data, running.hexdigest(), not left
                number, offset = number + 1, offset + len(data)
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {meta[0]} has no end")


def read_archives(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives in a manifest. One archive is the unit of work; the rows of
    a revisit are one, with the length of the payload it stands for as `offset`."""
    ship_package(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in read_records(stream, chunk):
                        rows.append(row)
                        size += len(row[6]) + 200
                        if size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
        yield _batch(rows)

    files = manifest.count()
    return manifest.select("path").repartition(max(files, 1)).mapInArrow(read, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_CHUNK_TYPES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _CHUNK_TYPES, strict=True)], schema=_CHUNK_TYPES)
