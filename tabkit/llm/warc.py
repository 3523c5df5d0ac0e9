"""WARC archives: records with revisits written by Spark, and a sequential reader.

Writing: one gzip member per record. Of records with equal payloads of at least ``least`` bytes the one with the smallest id holds the
payload (``response``), the others are ``revisit`` records that refer to it; rows that share that smallest id are all
responses. Members are written as raw bytes by Spark's text sink, so archives land wherever Spark can write; an empty gzip
member, which readers skip, stands where the sink wants a line separator.

Reading: each archive is inflated piece by piece, one member at a time; a record is framed by its Content-Length, its block
and payload digests are computed as bytes arrive, and ``problem`` says what does not hold (null for a sound record). A broken
member ends its archive with a row that says so; the other archives go on.

Null payloads are empty. A null id is written as such and comes back null; it is never the one referred to. Control characters and blanks of a URL are
percent-encoded. An empty table writes no record.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm.common import name
from tabkit.session import checkpoint_dir

PIECE = 1 << 16  # compressed bytes inflated at a time
ROW_BYTES = 2 << 20  # members written together
ROWS_PER_FILE = 32
# The names and forms of the WARC 1.1 and HTTP formats.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush().decode("latin-1")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _uri(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or with ``refers_to`` a revisit, before compression. The HTTP header keeps the payload's length in both."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_uri(uri)}"] if uri is not None else []
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(name(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(name(key).cast("string").alias("id"), name(key).alias("sort_id"), name(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min_by("id", "sort_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(first.where("n > 1").select("digest", "first"), "digest", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))

    def build(batches):
        waiting, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ident, uri, body, digest, to = (batch.column(c)[k].as_py() for c in range(5))
                waiting.append(_member(record_bytes(f"urn:record:{ident if ident is not None else ''}", uri, date, body, digest, to and f"urn:record:{to}")))
                size += len(waiting[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["members"])
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(waiting)], pa.binary())], ["members"])

    built = rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(build, "members binary")
    built.select(F.col("members").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


class _Record:
    """One record as its bytes arrive: header lines, then a block of Content-Length bytes, then an empty line."""

    def __init__(self):
        self.head, self.fields, self.length = bytearray(), None, 0
        self.block, self.block_digest, self.seen, self.tail = bytearray(), hashlib.sha256(), 0, bytearray()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC version line")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            if not self.fields.get("content-length", "").isdigit():
                raise ValueError("no content length")
            self.length = int(self.fields["content-length"])
            data = bytes(self.head[end + 4 :])
        inside = data[: self.length - self.seen]
        self.seen += len(inside)
        self.block += inside
        self.block_digest.update(inside)
        self.tail += data[len(inside) :]

    def row(self) -> dict:
        if self.fields is None or self.seen < self.length:
            raise ValueError("record cut short")
        get = self.fields.get
        http, _, payload = bytes(self.block).partition(b"\r\n\r\n")
        revisit = get("warc-type") == "revisit"
        http_length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), None)
        said = get("warc-payload-digest", "").removeprefix("sha256:")
        problems = []
        if bytes(self.tail) != b"\r\n\r\n":
            problems.append("record does not end after its content length")
        if get("warc-block-digest", f"sha256:{self.block_digest.hexdigest()}") != f"sha256:{self.block_digest.hexdigest()}":
            problems.append("block digest differs")
        digest = said if revisit else hashlib.sha256(payload).hexdigest()
        if said and said != digest:
            problems.append("payload digest differs")
        if not revisit and http_length is not None and http_length != len(payload):
            problems.append("payload length differs")
        bare = lambda x: x.strip("<>") if x is not None else None
        return {
            "warc_type": get("warc-type"), "record_id": bare(get("warc-record-id")), "target_uri": get("warc-target-uri"), "refers_to": bare(get("warc-refers-to")),
            "payload_digest": digest, "payload_bytes": http_length if revisit else len(payload), "payload": None if revisit else payload, "problem": "; ".join(problems) or None,
        }


def records(archive: bytes):
    """The records of an archive in order, inflated piece by piece; one member is one record."""
    at, rest = 0, b""
    view = memoryview(archive)
    try:
        while at < len(view) or rest:
            member, record, any_bytes = zlib.decompressobj(31), _Record(), False
            while not member.eof:
                piece = rest or view[at : at + PIECE]
                if not rest:
                    at += len(piece)
                rest = b""
                if not len(piece):
                    raise ValueError("gzip member cut short")
                data = member.decompress(piece, PIECE)
                while True:
                    any_bytes |= bool(data)
                    record.feed(data)
                    if member.eof or not member.unconsumed_tail:
                        break
                    data = member.decompress(member.unconsumed_tail, PIECE)
            rest = member.unused_data
            if any_bytes:
                yield record.row()
    except (ValueError, zlib.error) as e:
        yield {"problem": f"archive unreadable from here: {e}"}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: archive, position and the fields of ``RECORD``; revisits have no payload, and their length is the one their HTTP header states."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if "long" in x else pa.binary() if "binary" in x else pa.string() for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                archive, rows, size, first = batch.column(0)[k].as_py(), [], 0, 0

                def made(rows, first, archive=archive):
                    columns = [pa.array([archive] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int64())]
                    return pa.RecordBatch.from_arrays(columns + [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], ["archive", "position", *names])

                for row in records(batch.column(1)[k].as_buffer()):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 256
                    if size > 8 << 20:
                        yield made(rows, first)
                        rows, size, first = [], 0, first + len(rows)
                yield made(rows, first)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, position long, " + RECORD)


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tabkit", f"warc-{uuid.uuid4().hex}")
