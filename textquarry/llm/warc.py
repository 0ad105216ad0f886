"""Operator 7, WARC archives: writing, normalising a monolithic gzip, reading by a sidecar index.

`write` puts one record for each row into archives that are one gzip stream each. `normalise` inflates
each such stream once, front to back, and rewrites every record as a gzip member of its own beside
a sidecar index of offsets, so that a record can be read without what stands before it. `read`
goes by the sidecar: it seeks to each member, inflates it alone and checks its digest.

Of rows with equal payloads, the one with the largest page_id becomes a response and the others
revisits of it. Equality is that of SHA-1 and length; a hot payload costs one row per task in the
aggregate that finds its response, and the join that hands this out is one that adaptive execution splits.

Archives go to the folder in spark.checkpoint.dir through pyarrow's file systems (local, HDFS,
S3, ...), each under a name of its own; only those in the table that a step returns count, so what a
lost or repeated task has left is never read.

Defined results: a null payload is empty; payloads smaller than `least` bytes are all responses; a
null page_id is never referred to, and rows that only share a payload with such rows are responses, as
are all rows of the largest page_id (repeated rows, that is); a null url gives no target header; an empty table gives none; other
columns aren't read. A payload of any length is one record, which a task holds a few times over.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep, shared_dir

ARCHIVE_BYTES = 32 << 20
LEVEL = 6
URN = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") and not path.startswith("//") else path)


def _uri(folder: str) -> str:
    """Hadoop writes file:/x where others write file:///x."""
    return "file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str = "response", refers_to: int | None = None) -> bytes:
    """A WARC record; a revisit has its HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, all bytes) of each record of an inflated stream."""
    while True:
        head = [stream.readline()]
        if not head[0]:
            return
        while head[-1] not in (b"\r\n", b""):
            head.append(stream.readline())
        fields = dict(x.decode().rstrip("\r\n").split(": ", 1) for x in head[1:-1])
        size = int(fields["Content-Length"])
        rest = stream.read(size + 4)
        if not head[0].startswith(b"WARC/") or head[-1] == b"" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("broken WARC record")
        yield fields, rest[:size], b"".join(head) + rest


def _kinds(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html and, for revisits, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_key", F.concat_ws(":", F.sha1(F.col("html").cast("binary")), F.octet_length("html").cast("string")))
    own = rows.where(F.octet_length("html") >= least).groupBy("_key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))
    return rows.join(own, "_key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes the archives; a row (path, n) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root)
        out, done, size, n = None, [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    raw = system.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=level, mtime=0)
                    size = n = 0
                item = record(page_id, url, html.encode(), "response" if refers_to is None else "revisit", refers_to)
                out.write(item)
                size, n = size + len(item), n + 1
                if size >= archive_bytes:
                    out.close(), raw.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close(), raw.close()
            done.append((name, n))
        prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        yield pa.RecordBatch.from_arrays([pa.array([prefix + x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["path", "n"])

    return keep(_kinds(pages, least).mapInArrow(run, "path string, n bigint"))


def _each_archive(archives: DataFrame) -> DataFrame:
    """A task for each archive."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Rewrites archives(path): (path, n, bytes) of the new ones, each with a sidecar, path + ".idx"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _opened(path)
                to = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                at = n = 0
                with system.open_input_stream(name, compression=None, buffer_size=1 << 16) as raw, gzip.GzipFile(fileobj=raw) as stream, system.open_output_stream(to, compression=None, buffer_size=1 << 16) as out, system.open_output_stream(f"{to}.idx", compression=None, buffer_size=1 << 16) as side:
                    for fields, _, whole in records(stream):
                        member = gzip.compress(whole, level, mtime=0)
                        out.write(member)
                        side.write((json.dumps([at, len(member), fields["WARC-Type"], fields["WARC-Record-ID"]]) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([path[: len(path) - len(name)] + to]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], names=["path", "n", "bytes"])

    return keep(_each_archive(archives.select("path")).mapInArrow(run, "path string, n bigint, bytes bigint"))


def _number(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(URN)
    return int(text) if text else None


def _row(fields: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": _number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, by the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _opened(path)
                rows = []
                with system.open_input_file(name) as file, system.open_input_stream(f"{name}.idx", compression=None) as side:
                    for line in side.read().splitlines():
                        offset, length, _, _ = json.loads(line)
                        whole = gzip.decompress(file.read_at(length, offset))
                        head, _, rest = whole.partition(b"\r\n\r\n")
                        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        rows.append(_row(fields, rest[: int(fields["Content-Length"])]))
                yield pa.RecordBatch.from_pylist(rows, schema=ROW)

    return _each_archive(archives.select("path")).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages(page_id, url, html), normalises the archives and reads them back."""
    folder = f"{_uri(shared_dir(pages.sparkSession))}/warc-{uuid.uuid4().hex}"
    return read(normalise(write(pages, folder, least)))
