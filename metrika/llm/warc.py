"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, and an index of frame-relative offsets.

A bundle is a row (bundle, data, index) of a Parquet table in the shared folder, so executors need no file system of their
own; `data` is a complete .warc.zst file in the public seekable Zstandard format.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import named_files
from .common import written

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 4 << 20, 3
DATE = "2000-01-01T00:00:00Z"
INDEX = "array<struct<page_id:long,record_id:string,frame:int,offset:long,length:long>>"
BUNDLES = f"bundle string, data binary, index {INDEX}"
RECORDS = "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BundleWriter:
    """Groups records into frames of about frame_bytes; a record never spans two frames."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.frame_bytes, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.bytes = 0
        self.index: list[dict] = []

    def add(self, page_id: int | None, record_id: str, record: bytes) -> None:
        self.index.append({"page_id": page_id, "record_id": record_id, "frame": len(self.sizes), "offset": self.filled, "length": len(record)})
        self.open.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self.cut()

    def cut(self) -> None:
        if self.open:
            self.out.append(self.zip.compress(b"".join(self.open)))
            self.sizes.append((len(self.out[-1]), self.filled))
            self.bytes += len(self.out[-1])
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self.cut()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.out) + struct.pack("<II", SKIPPABLE, len(table)) + table


class Bundle:
    """A finished bundle: any frame can be read alone."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        n, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table at the end of the bundle")
        table = self.data[-9 - 8 * n : -9]
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        if struct.unpack("<II", self.data[at : at + 8]) != (SKIPPABLE, 8 * n + 9):
            raise ValueError("the seek table does not follow the last frame")

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[k]
        out = zstandard.ZstdDecompressor().decompress(self.data[at : at + packed], max_output_size=plain)
        if len(out) != plain:
            raise ValueError(f"frame {k} has {len(out)} bytes, not {plain}")
        return out

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest())}>"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, revisit: bool, date: str = DATE) -> tuple[str, bytes]:
    """Record id and bytes of a WARC/1.1 record; a revisit has an empty block and names what it refers to."""
    rid = record_id(page_id, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keeper, digest)}", f"X-Refers-To-Page: {keeper}"]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts here")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def write_archives(pages: DataFrame, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and returns the table of bundles (bundle, data, index).

    Of records with equal payloads of at least least_bytes bytes, that with the largest page_id is a response and the others
    are revisits of it; smaller payloads are always responses. Null html is an empty payload; a null page_id is smaller than
    any other and has no page header; a null url becomes urn:none. Rows that repeat page_id and payload are alike: all of
    them are responses if theirs is the largest page_id. Empty pages give no bundle. Other columns are never read.

    Only (digest, page_id) is grouped; the html joins the few digests that occur twice or more. Spark broadcasts that table
    if its files are small, and else joins with plain exchanges on both sides, which adaptive execution splits for a hot
    payload. Memory holds one open bundle a task, or a record where that is longer: a payload of any length is one record
    in a frame of its own, never cut.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha1"))
    groups = written(
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).filter("n > 1").select("sha1", "keeper"),
        "warc-groups",
    )
    enough = F.octet_length("payload") >= least_bytes
    marked = rows.join(groups, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", "keeper",
        F.coalesce(enough & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False)).alias("revisit"),
    )

    def write(batches):
        part, n, w = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def done():
            data = w.finish()
            return pa.RecordBatch.from_pylist([{"bundle": f"part-{part:06d}-{n:06d}.warc.zst", "data": data, "index": w.index}], schema=schema)

        for b in batches:
            for x in b.to_pylist():
                digest = base32(x["sha1"])
                rid, data = record(x["page_id"], x["url"], x["payload"], digest, x["keeper"], x["revisit"])
                w.add(x["page_id"], rid, data)
                if w.bytes >= bundle_bytes:
                    yield done()
                    n, w = n + 1, BundleWriter(frame_bytes)
        if w.index:
            yield done()

    entry = pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(entry))])
    return written(marked.mapInArrow(write, BUNDLES), "warc-bundles")


def save_archives(bundles: DataFrame, folder: str) -> None:
    """A file bundle-<number>.warc.zst for each bundle, in a folder that driver and executors share. Files appear when all are
    written. Any Zstandard reader reads them from start to end; the table at their end gives single frames."""
    name = F.concat(F.lit("bundle-"), F.col("bundle"), F.lit(".warc.zst"))
    named_files.write_files(bundles.select(name.alias("name"), F.col("data").alias("content")), folder)


def saved_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles (bundle, data) of a folder that save_archives wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "bundle-*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"bundle-(-?\d+)[.]warc[.]zst$", 1).cast("long").alias("bundle"), F.col("content").alias("data"))


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle, frame, offset, length): where each record starts inside its frame."""
    return bundles.select("bundle", F.explode("index").alias("x")).select("x.record_id", "x.page_id", "bundle", "x.frame", "x.offset", "x.length")


def read_archives(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, frame by frame; digests of responses are computed anew and must agree with the headers.

    Records without a page header have a null page_id. Bundles of no records, and a table without bundles, give no rows; only
    the columns `bundle` and `data` are read. One frame, or one record where that is longer, is in memory at a time.
    """

    def read(batches):
        for b in batches:
            for data in b.column(0):
                bundle = Bundle(data.as_buffer())
                for k in range(len(bundle.frames)):
                    out = []
                    for head, block in records(bundle.frame(k)):
                        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and base32(hashlib.sha1(block).digest()) != digest:
                            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have the digest of its header")
                        number = lambda name: int(head[name]) if name in head and head[name] != "None" else None  # noqa: B023, E731
                        out.append({
                            "page_id": number("X-Page-Id"), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
                            "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(block), "payload_digest": digest, "payload": block if payloads else None,
                        })
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    return bundles.select("data").mapInArrow(read, RECORDS)
