"""WARC archives as seekable Zstandard bundles.

One WARC record is written for each page.  Of the records with equal payloads of
at least `dedupe_from` bytes, that with the largest page_id is the response and
the others are revisits that refer to it; smaller payloads are all responses.
Only responses carry their payload: the digests are compared first, on narrow
rows, and the html of a revisit never reaches the writer.

A bundle is a file of independent Zstandard frames of about FRAME_BYTES of whole
records, closed by the public seek table (a skippable frame with the sizes of
all frames and a footer), so any Zstandard reader can read it from end to end and
a seeking reader can open any frame alone.  The index table maps each record to
bundle, frame and offset within the frame.  Writers hold one frame at a time and
name files by task attempt; only files in the written index count, so a lost
executor leaves at most a stray file.  Paths go through pyarrow's filesystems.

Defined cases: a null html is an empty payload; a null url leaves the target
header out; a null page_id is smaller than all others; of rows that repeat the
largest page_id one is the response; extra columns are not touched; an empty
table gives no bundle and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.llm.common import shared_dir, table
from gistmill.llm.kernel import columns

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# fixed values of the public seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, path string, frame int, offset long, length long"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record at an offset."""
    stop = frame.index(b"\r\n\r\n", at)
    lines = frame[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    end = stop + 4 + int(head["content-length"])
    if frame[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record that does not end")
    return head, frame[stop + 4 : end], end + 4


class BundleWriter:
    """Appends records to one bundle on an open stream."""

    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.size, self.frames, self.written = [], 0, [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        file.seek(size - 9 - width * count)
        table_bytes = file.read(width * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", table_bytes, width * i)
            self.frames.append((at, packed, raw))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, raw = self.frames[i]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=raw)


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _open(folder)
        writer, path, count = None, "", 0
        for batch in batches:
            out = [[], [], [], []]
            ids, *cols = columns(batch, "page_id", "url", "html", "size", "digest", "type", "refers_to")
            ids = ids.to_pylist()
            for page_id, *row in zip(ids, *(c.to_pylist() for c in cols), strict=True):
                url, html, size, digest, kind, refers_to = row
                if writer is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.zst"
                    path, count = f"{folder}/{name}", count + 1
                    writer = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                raw = record(page_id, url, kind, base64.b32encode(bytes.fromhex(digest)).decode(), size, refers_to, html.encode() if html is not None else None)
                for o, v in zip(out, (path, *writer.add(raw), len(raw)), strict=True):
                    o.append(v)
                if writer.written > BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["page_id", "path", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return run


def write_archive(pages: DataFrame, *, dedupe_from: int = 0, folder: str | None = None) -> DataFrame:
    """Write the bundles into `folder` (by default in the shared folder) and return
    the index: page_id, path, frame, offset, length."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    narrow = p.where(F.col("size") >= dedupe_from).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = narrow.groupBy("digest").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "n")).alias("top"))
    first = table(first.select(F.col("digest").alias("d"), F.col("top.page_id").alias("first"), (F.col("top.n") > 1).alias("tied")), "responses")
    joined = p.join(first, (F.col("digest") == F.col("d")) & (F.col("size") >= dedupe_from), "left")
    leads = F.col("d").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    tied = leads & F.coalesce("tied", F.lit(False))
    keep = ["page_id", "url", "html", "size", "digest", "first", "leads"]
    rows = joined.withColumn("leads", leads).select(*keep)
    if not first.where("tied").isEmpty():  # rows that repeat the leading page_id: one is the response
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        once = joined.where(tied).withColumn("leads", nth == 1).select(*keep)
        rows = joined.where(~tied).withColumn("leads", leads).select(*keep).unionByName(once)
    rows = rows.select("page_id", "url", F.when(F.col("leads"), F.coalesce("html", F.lit(""))).alias("html"), "size", "digest", F.when(F.col("leads"), "response").otherwise("revisit").alias("type"), F.when(~F.col("leads"), F.col("first")).alias("refers_to"))
    return table(rows.mapInArrow(_write(folder), INDEX), "warc-index")


def _number(text: str) -> int | None:
    value = text.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = _open(path)
            reader = BundleReader(fs.open_input_file(name))
            for i in range(len(reader.frames)):
                frame, at, out = reader.frame(i), 0, []
                while at < len(frame):
                    head, block, at = parse(frame, at)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    response = head["warc-type"] == "response"
                    if response and (len(payload) != size or base32_digest(payload) != digest):
                        raise ValueError(f"a damaged record in {path}")
                    out.append((_number(head["warc-record-id"]), size, digest, head["warc-type"], None if response else _number(head["warc-refers-to"])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archive(index: DataFrame) -> DataFrame:
    """A row for each record of the bundles in an index, read frame by frame."""
    paths = index.select("path").distinct()
    bundles = max(1, paths.count())  # a task each; dealt by path, tasks would be merged where this is the number of shuffle partitions
    return paths.repartition(bundles).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, frame = None, b""
    for batch in batches:
        out = []
        for path, i, at in zip(*(c.to_pylist() for c in columns(batch, "path", "frame", "offset")), strict=True):
            if (path, i) != last:
                fs, name = _open(path)
                last, frame = (path, i), BundleReader(fs.open_input_file(name)).frame(i)
            out.append(parse(frame, at)[1].partition(b"\r\n\r\n")[2])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("page_id")), pa.array(out, pa.binary())], ["page_id", "payload"])


def fetch(index_rows: DataFrame) -> DataFrame:
    """page_id and stored payload of the given index rows, opening their frames only."""
    rows = index_rows.select("page_id", "path", "frame", "offset").repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return rows.mapInArrow(_fetch, "page_id long, payload binary")


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, then read the archives back."""
    return read_archive(write_archive(pages))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
d AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id DESC NULLS LAST) AS nth, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, payload_bytes,
  list_aggregate([ 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(1 + ((('0x' || hex[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT] FOR i IN range(0, 32) ], 'string_agg', '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN top END AS refers_to
FROM d"""
