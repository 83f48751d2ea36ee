"""WARC archives: a writer with revisit records and a splittable reader.

The writer makes one gzip member per record.  Each task writes its members as
bytes to a draft in the target folder and renames it when it is whole, so a
repeated task replaces its file; the list of files is committed by Spark as
``_files``.  The reader lists files and lengths with Spark, deals byte ranges
evenly to as many tasks as there are ranges (``MAX_READ_TASKS`` at most), and
each task scans its range for the gzip magic, checks each candidate by decoding
its head, and owns the records that start inside, reading past the end of its
range only to finish the last one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, bound_batches, cut, scratch

MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 32 << 20
READ_BYTES = 256 << 10
MAX_READ_TASKS = 10_000
MAGIC = b"\x1f\x8b\x08"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set where a record only points to an equal payload.

    Payloads are grouped by digest with partial sums, so a payload shared by a
    third of the pages is no hot group; only groups of two and more are joined
    back, by broadcast while their table is small.  Null html is empty; a null
    page_id comes after all others; equal rows with one id are all responses.
    """
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    digest = F.sha2(F.col("html").cast("binary"), 256)
    groups = (
        own.filter(F.octet_length("html") >= MIN_REVISIT_BYTES)
        .select("page_id", digest.alias("__digest"))
        .groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    groups = cut(groups)
    if groups.count() * 128 <= BROADCAST_BYTES:
        groups = F.broadcast(groups)
    joined = own.join(groups, (digest == groups["__digest"]) & (F.octet_length("html") >= MIN_REVISIT_BYTES), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("__first")).alias("refers_to"))


def _member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = HTTP_HEAD.format(len(payload)).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _store(path: str):
    """(pyarrow's file system of a path, the path in it): local, S3, GCS, HDFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_warc(planned: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> None:
    """Write the records of :func:`plan_records` as gzip WARC files below ``path``, one for each task that has rows.

    Repeated rows give as many records.  An empty table gives no file but the
    list.  A folder that holds archives of this writer already is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = _store(path)
        name = f"part-{task.partitionId():05d}.warc.gz"
        draft, out, records = f"{folder}/.{name}.{task.taskAttemptId()}", None, 0
        with ExitStack() as files:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(4))):
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = files.enter_context(store.open_output_stream(draft, compression=None))
                    page_id, url, payload, refers_to = (v.as_py() for v in row)
                    out.write(_member(page_id, url, payload, refers_to, date, level))
                    records += 1
        if out is not None:
            store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])

    bound_batches(planned.sparkSession)
    rows = planned.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    rows.mapInArrow(work, "file string, records long").write.parquet(f"{path.rstrip('/')}/_files")


class _Window:
    """Bytes of a file from a position on, read piece by piece."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.held = file, start, size, b""

    def upto(self, end: int) -> None:
        have = self.start + len(self.held)
        if end > have:
            self.file.seek(have)
            self.held += self.file.read(min(end, self.size) - have)

    def drop(self, to: int) -> None:
        """Forget what lies before ``to``."""
        if to >= self.start + len(self.held):
            self.start, self.held = to, b""
        elif to > self.start:
            self.held, self.start = self.held[to - self.start :], to


def _whole_member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at``; None where there is no WARC record or empty member."""
    unpack, parts, pos, known = zlib.decompressobj(31), [], at, False
    while not unpack.eof:
        window.upto(pos + READ_BYTES)
        piece = window.held[pos - window.start : pos - window.start + READ_BYTES]
        if not piece:
            return None  # cut off
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        if not known:
            start = b"".join(parts)[:5]
            if not b"WARC/".startswith(start):
                return None
            known = len(start) == 5
    return b"".join(parts), pos - len(unpack.unused_data)


def members_in_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records whose gzip member starts in [start, end)."""
    window, at = _Window(file, start, size), start
    while at < min(end, size):
        window.drop(at)
        window.upto(at + READ_BYTES)
        found = window.held.find(MAGIC)
        if found < 0:
            at = max(at + 1, window.start + len(window.held) - len(MAGIC) + 1)
            continue
        at = window.start + found
        if at >= end:
            return
        member = _whole_member(window, at)
        if member is None:
            at += 1
            continue
        content, at = member
        if content:
            yield content


def parse_record(record: bytes) -> tuple:
    """One row of RECORDS. The digest of a response is computed from its payload, a revisit's is the one it states."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    number = lambda v: int(v) if v else None
    page_id = number(fields.get("warc-record-id", "").removeprefix("<urn:x-page:").rstrip(">"))
    kind = fields.get("warc-type", "")
    block = rest[: int(fields.get("content-length", len(rest)))]
    if kind == "revisit":
        refers = number(fields.get("warc-refers-to", "").removeprefix("<urn:x-page:").rstrip(">"))
        return page_id, fields.get("warc-target-uri"), kind, refers, number(fields.get("warc-payload-length")), fields.get("warc-payload-digest", "").partition(":")[2], None
    payload = block.partition(b"\r\n\r\n")[2]
    return page_id, fields.get("warc-target-uri"), kind, None, len(payload), hashlib.sha256(payload).hexdigest(), payload


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records (RECORDS) of all gzip WARC files below ``path``, in byte ranges of ``split_bytes``.

    Ranges are opened with pyarrow's file systems (local, S3, GCS, HDFS).
    Bytes that belong to no record are passed over, and so are drafts, whose
    names begin with a dot.  A folder without files has no records.  Without
    ``payload`` that column is null.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    # From one partition rows go round to all others in turn; a number that is given is not coalesced. Paths and lengths alone travel.
    ranges = ranges.coalesce(1).repartition(max(1, min(ranges.count(), MAX_READ_TASKS)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORDS.names)

        for batch in batches:
            for name, size, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                store, inner = _store(name)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    for record in members_in_range(file, size, start, start + split_bytes):
                        row = parse_record(record)
                        rows.append(row if payload else (*row[:-1], None))
                        held += len(record) if payload else 0
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(work, RECORDS)


def warc_round_trip(pages: DataFrame, path: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Repeated rows are records each; those with
    one id are all responses.  An empty table gives an empty result.  Without
    ``path`` the archives lie in the shared folder until the session ends.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(plan_records(pages), path)
    return read_warc(spark, path, split_bytes, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
