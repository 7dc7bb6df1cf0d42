"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC records, then a skippable
frame with the public seek-table layout (sizes of every frame, a footer with their number and a magic
number). Any Zstandard reader can unpack it from the start; a reader of the footer can open one frame.
Bundles are cells of a Parquet table, so Spark's commit protocol covers lost executors and every store
that Spark writes to; next to its bytes each bundle has its index: record identifier to frame and
offset in the unpacked frame.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
BUNDLES = "bundle_id string, n_records long, data binary, record_index array<struct<record_id:string,frame:int,offset:long,length:long>>"
BUNDLE_ARROW = pa.schema(
    [
        ("bundle_id", pa.string()),
        ("n_records", pa.int64()),
        ("data", pa.binary()),
        ("record_index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)
READ_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
)


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """The archive records of pages (page_id, url, html), by RECORDS.

    A null html is an empty payload. Of records with equal payloads of at least min_bytes the one with the
    largest page_id is the response, the others are revisits of it; smaller ones are all responses. Rows
    that repeat the largest page_id are responses too; a null page_id is never referred to. The winners
    are aggregated by digest before any join, and only digests that occur twice are joined back.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_winner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = rows.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_winner"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_winner")).alias("refers_to"),
    )


def record_name(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _number(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def encode_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A revisit holds the HTTP head only; its Content-Length tells the full payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_name(page_id)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to)}>")]
    block = head if kind == "revisit" else head + payload
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_records(data: bytes) -> Iterator[dict]:
    """The records of an unpacked frame, by READ_ARROW's names; a payload that belies its digest raises ValueError."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, length = end + 4, int(fields["Content-Length"])
        block = data[start : start + length]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        digest, kind = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"]
        if kind == "response":
            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
        uri = fields.get("WARC-Target-URI")
        yield {
            "page_id": _number(fields["WARC-Record-ID"]),
            "url": None if uri is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), uri),
            "payload": payload if kind == "response" else None,
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": _number(fields.get("WARC-Refers-To")),
        }
        at = start + length + 4


class BundleWriter:
    """Collects records into frames of about frame_bytes and closes with the seek table."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.frames, self.index = io.BytesIO(), [], []
        self.pending: list[bytes] = []
        self.pending_bytes = 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.pending_bytes, "length": len(record)})
        self.pending.append(record)
        self.pending_bytes += len(record)
        if self.pending_bytes >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.frames.append((len(packed), self.pending_bytes))
            self.out.write(packed)
            self.pending, self.pending_bytes = [], 0

    def size(self) -> int:
        return self.out.tell()

    def finish(self) -> bytes:
        self._close_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        return self.out.getvalue()


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of every frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    at, found = len(bundle) - 9 - 8 * n, []
    start = 0
    for packed, plain in struct.iter_unpack("<II", bundle[at:-9]):
        found.append((start, packed, plain))
        start += packed
    return found


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> dict:
    """Random access: unpack one frame and decode the record at the index's offset in it."""
    return next(decode_records(read_frame(bundle, frame)[offset : offset + length]))


def write_bundles(records: DataFrame, frame_bytes: int = 1 << 18, bundle_bytes: int = 4 << 20) -> DataFrame:
    """Bundles (BUNDLES) of the records (RECORDS). A task holds one open bundle; an empty table makes none."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def close() -> pa.RecordBatch:
            row = {"bundle_id": f"{part:07d}-{made:06d}", "n_records": len(writer.index), "data": writer.finish(), "record_index": writer.index}
            return pa.RecordBatch.from_pylist([row], schema=BUNDLE_ARROW)

        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in r)
                writer.add(record_name(page_id), encode_record(page_id, url, payload, digest, kind, refers_to))
                if writer.size() >= bundle_bytes:
                    yield close()
                    made, writer = made + 1, BundleWriter(frame_bytes)
        if writer.index:
            yield close()

    return records.mapInArrow(pack, BUNDLES)


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all bundles (RECORDS; a revisit's payload is null), every digest checked; one frame in memory at a time."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                bundle = cell.as_py()
                for frame in range(len(seek_table(bundle))):
                    rows = list(decode_records(read_frame(bundle, frame)))
                    if not payloads:
                        rows = [r | {"payload": None} for r in rows]
                    yield pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

    return bundles.select("data").mapInArrow(unpack, RECORDS)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset and length: where every record lies."""
    return bundles.select("bundle_id", F.explode("record_index").alias("r")).select("r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")
