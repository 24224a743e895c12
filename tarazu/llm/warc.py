"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.common import materialise, new_path

#: Fixed values of the seekable format: a skippable frame of (compressed, plain) sizes, then frame count, flags and a closing magic.
SEEK_FRAME, SEEK_END = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Bundle:
    """Writes records into independent frames of about frame_bytes, and the seek table behind them.

    It goes to a name of its own and is moved to its final one when complete, so a task that is lost
    or runs twice leaves no half-written bundle behind a name that anyone reads.
    """

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.uri, self.frame_bytes, self.zstd = uri, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.sizes, self.frame, self.plain, self.written = self.fs.open_output_stream(self.path + ".part"), [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within the frame's plain bytes)."""
        if self.plain and self.plain + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.sizes), self.plain
        self.frame.append(record)
        self.plain += len(record)
        return at

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.plain))
            self.written += len(packed)
            self.frame, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_END)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_END:
            raise ValueError(f"{uri}: no seek table")
        sizes = struct.iter_unpack("<II", self.file.read_at(8 * n, end - 9 - 8 * n))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def make_record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response, or where refers_to is given a revisit, which keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page or ''}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(WARC header, HTTP header, payload, where the next record starts)."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload, end + 8 + len(block)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row and return the index (id, file, frame, offset, length), offset within the frame.

    Of rows with equal payloads of at least `min_payload` bytes the one with the largest id is the response
    and the others revisit it; rows that share the largest id are all responses, and so are those of a group
    without any id. A null payload is an empty one; a null URL is left out; a null id has an empty record name
    and is below all others. An empty table gives an empty index and no file. Other columns are not read.

    Payloads are compared by digest: one partial aggregation of digests, and only the ids of revisits are
    joined back (broadcast where Spark finds their table small enough), so payloads don't pile up with their copies.
    A payload is held whole by its task, as is a frame of at least one record. Each task writes bundles of its own to the
    folder, which all executors must share (default: a new one in the shared folder); what else is there stays, also archives of earlier calls.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    digests, _ = materialise(rows.where(F.octet_length("payload") >= min_payload).select("id", "sha1"), "digests")
    kept = digests.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = digests.join(kept, "sha1").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select(F.col("id").alias("rid"), F.col("sha1").alias("rsha"), "refers_to").distinct()
    revisits, _ = materialise(revisits, "revisits")  # so that its size is known: payloads move only if it is too large to broadcast
    rows = rows.join(revisits, rows.id.eqNullSafe(revisits.rid) & (rows.sha1 == revisits.rsha), "left").select(F.col("id").cast("string").alias("id"), "url", "payload", "sha1", F.col("refers_to").cast("string").alias("refers_to"))

    run = uuid.uuid4().hex[:16]  # in the names of this call's files, so that no others are taken for its leftovers

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bundle, n = TaskContext.get(), None, 0
        for b in batches:
            index = []
            for page, url, body, sha1, refers_to in zip(*(b.column(c) for c in ("id", "url", "payload", "sha1", "refers_to"))):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{run}-{task.partitionId():06d}-{task.taskAttemptId():06d}-{n:04d}.warc.zst", frame_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                record = make_record(page.as_py(), url.as_py(), body.as_py(), digest, refers_to.as_py(), date)
                index.append((page.as_py(), bundle.uri, *bundle.add(record), len(record)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle, n = None, n + 1
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(x) if k else pa.array(x, pa.string()) for k, x in enumerate(zip(*index))], ["id", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    uri = folder if re.match(r"\w+:", folder) else f"file://{folder}"
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    folder = uri
    index, _ = materialise(rows.mapInArrow(write, "id string, file string, frame long, offset long, length long"), "warc-index")
    named = {r.file.rsplit("/", 1)[1] for r in index.select("file").distinct().collect()}  # one name for each bundle_bytes of archive
    for left in fs.get_file_info(pa.fs.FileSelector(path)):  # by attempts that failed or lost a race
        if left.is_file and left.base_name.startswith(f"{run}-") and left.base_name not in named:
            fs.delete_file(left.path)
    return index.select(F.col("id").cast(pages.schema[id_col].dataType).alias(id_col), "file", "frame", "offset", "length")


def read_archives(spark: SparkSession, index: DataFrame, payloads: bool = False, id_col: str = "page_id", frames: int = 64) -> DataFrame:
    """The records that the index names: page (text), payload_bytes, payload_digest, record_type, refers_to (text) and with `payloads` the payload.

    Each record is sought by its file, frame and offset within the frame: rows of the index meet by file and run
    of `frames` frames, so that a bundle is read by many tasks, each unpacks only the frames with records
    that it wants, every frame once, and holds one frame at a time. An index filtered to some ids reads only theirs.
    A response's digest is checked against its payload, and a record's name against the index. Null ids, repeated
    rows and ties come back as they were written; an empty index gives no rows; other columns of the index stay unread.
    """
    name = lambda uri: (uri or "").removeprefix("<urn:page:").removesuffix(">") or None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, now, data = None, None, b""
        for b in batches:
            out = []
            for page, file, frame, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if (file, frame) != now:
                    bundle = bundle if now and now[0] == file else BundleReader(file)
                    now, data = (file, frame), bundle.frame(frame)
                head, http, payload, _ = parse_record(data[offset : offset + length])
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if name(head["WARC-Record-ID"]) != page:
                    raise ValueError(f"{file}: {head['WARC-Record-ID']} where the index has {page}")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file}: wrong digest of {head['WARC-Record-ID']}")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                out.append((page, size, digest, kind, name(head.get("WARC-Refers-To")), payload if payloads and kind == "response" else None))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    wanted = index.select(F.col(id_col).cast("string").alias("page"), "file", "frame", "offset", "length")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, so that small rows aren't put into one task
    wanted = wanted.repartition(parts, "file", F.floor(F.col("frame") / frames)).sortWithinPartitions("file", "frame", "offset")
    out = wanted.mapInArrow(read, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out if payloads else out.drop("payload")
