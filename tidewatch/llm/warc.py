"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own.  The reader gives tasks byte ranges of
files.  A task scans its range for the gzip magic, accepts a candidate only if
it decodes to a WARC header, its member ends with a right checksum and another
such member, or the file's end, follows; from there it walks from member to
member and owns all records that start inside its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, importable

#: Bytes from which equal payloads are written once; a file's bytes before the next begins; bytes of a read range.
REVISIT_BYTES, FILE_BYTES, SPLIT_BYTES = 0, 256 << 20, 32 << 20
_MAGIC = b"\x1f\x8b\x08"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; payload None: a revisit of refers_to."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _rows(batch: pa.RecordBatch, columns: tuple[str, ...], step: int = 256) -> Iterator[tuple]:
    """Rows of a batch, a few at a time as Python values."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(c).to_pylist() for c in columns))


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        number, out, held, size = 0, None, [], 0

        def name(n: int) -> str:
            return f"{base}/part-{task.partitionId():06d}-{n:04d}.warc.gz"

        def close() -> pa.RecordBatch:
            # a finished file takes its name at once: a repeated or doubled attempt replaces it by an equal one
            out.close()
            fs.move(held[0], name(number))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name(number).rpartition('/')[2]}"]), pa.array([size], pa.int64()), pa.array([held[1]], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for page_id, url, html, n, sha1, refers_to in _rows(batch, ("page_id", "url", "html", "size", "sha1", "refers_to")):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    held = [f"{base}/.{task.taskAttemptId()}-{number}", 0]
                    out = fs.open_output_stream(held[0])
                member = gzip.compress(record(page_id, url, None if refers_to is not None else (html or "").encode(), n, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date), 6, mtime=0)
                out.write(member)
                size += len(member)
                held[1] += 1
                if size >= file_bytes:
                    yield close()
                    number, out, size = number + 1, None, 0
        if out is not None:
            yield close()

    return run


def _revisits(rows: DataFrame, revisit_bytes: int) -> DataFrame:
    """(ident, sha1, refers_to) of the rows that revisit another, decided on digests and ids only."""
    small = rows.select("page_id", "ident", "sha1", "size").where(F.col("size") >= revisit_bytes)
    first = small.groupBy("sha1", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return small.join(first, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("ident", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into folder; returns lazily path, bytes, records of its files.

    The folder must be one that all executors reach by pyarrow's file systems
    (file, hdfs, s3).  Of equal payloads of at least ``revisit_bytes`` bytes the row with the largest
    page_id is a response, all others revisit it; smaller ones are all responses.

    Which rows are revisits is decided on ids and digests and written as a table; payloads only move if that
    table is too large to broadcast, and then by (page_id, digest), never by the digest alone.

    Null html is an empty payload, a null url becomes a name of the page.  Repeated rows with the
    largest id are responses each; a row without an id revisits its equal
    with one, or is a response.  A very long payload is one record.  An empty table writes no file.  Further columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    html = F.col("html").cast("string")
    raw = F.coalesce(html, F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("ident"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(raw).cast("long").alias("size"), F.sha1(raw).alias("sha1"))
    found = scratch.table(_revisits(rows, revisit_bytes))
    joined = rows.join(found, ["ident", "sha1"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to").mapInArrow(_write(folder, date, file_bytes), "path string, bytes long, records long")


class _Source:
    """Bytes of a file by place, through one buffer."""

    def __init__(self, path: str, most: int = 1 << 20):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file, self.most = fs.open_input_file(name), most
        self.size, self.at, self.held = self.file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.most))
        return self.held[at - self.at : at - self.at + n]


def _header_at(src: _Source, at: int) -> bool:
    """Whether a gzip member at this place begins with a WARC version line."""
    raw = src.get(at, 4096)
    if raw[:3] != _MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(raw, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(src: _Source, at: int) -> tuple[bytes, int] | None:
    """The member at this place and the place after it, if it decodes with its checksum."""
    z, out, step, p = zlib.decompressobj(31), [], 1 << 16, at
    try:
        while not z.eof:
            raw = src.get(p, step)
            if not raw:
                return None
            out.append(z.decompress(raw))
            p += len(raw)
    except zlib.error:
        return None
    return b"".join(out), p - len(z.unused_data)


def _first_member(src: _Source, start: int, end: int) -> int | None:
    """The first place in [start, end) where a true member begins."""
    at, step = start, 1 << 18
    while at < end:
        raw = src.get(at, min(step, end - at) + 2)
        i = raw.find(_MAGIC)
        while i >= 0 and at + i < end:
            p = at + i
            if _header_at(src, p) and (m := _member(src, p)) and (m[1] == src.size or _header_at(src, m[1])):
                return p
            i = raw.find(_MAGIC, i + 1)
        at += min(step, end - at)
    return None


def parse(raw: bytes) -> dict:
    """A record's fields; payload is None in revisits."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    number = lambda x: int(m[1]) if (m := _ID.search(fields.get(x, ""))) else None
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    revisit = fields.get("warc-type") == "revisit"
    own = said if revisit else digest(payload)
    return {
        "page_id": number("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_to": number("warc-refers-to"),
        "payload_bytes": int(size[1]) if revisit and size else len(payload), "payload_digest": own, "digest_ok": own == said, "payload": None if revisit else payload,
    }


READ_SCHEMA = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            src, rows, size = _Source(path), [], 0
            at = _first_member(src, start, end)
            while at is not None and at < end:
                m = _member(src, at)
                if m is None:  # damage: go on at the next true member
                    at = _first_member(src, at + 1, end)
                    continue
                rows.append(parse(m[0]))
                size += len(m[0])
                at = m[1]
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives; files: path and bytes (such as write_archives returns), other columns are ignored.

    Byte ranges of ``split_bytes`` are dealt over tasks.  Damaged stretches are
    skipped up to the next true member; null, empty or missing sizes, empty files and an empty table have no records; a file
    named twice is read twice.  A record of any length belongs to the range it starts in.  Ids and digests that a record lacks are null.
    """
    importable(spark)
    n = F.ceil(F.col("bytes") / split_bytes).cast("int")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    ranges = ranges.select("path", (F.col("k") * F.lit(split_bytes).cast("long")).alias("start"), F.least(F.col("bytes"), (F.col("k") + 1) * F.lit(split_bytes).cast("long")).alias("end"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read, READ_SCHEMA)


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives of pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to; one row per row of pages.

    Nulls, empty and very long payloads, equal payloads, repeated rows, empty tables and further columns as in write_archives().
    """
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.table(write_archives(pages, scratch.new_path(), revisit_bytes))
    return read_archives(pages.sparkSession, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
  max(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d
"""
