"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a longer record is a frame of its own. A bundle ends in
the seek table of the seekable format, and a map from record id to frame, offset in the frame and length travels with it: a
record is read by decompressing one frame. Bundles are rows of a written table, so that any executor can make or read them.

Defined results: a null html is an empty payload. Records with equal payloads of at least min_bytes bytes: the one
with the smallest page_id is the response, the others revisit it; rows that share a page_id with the response are
responses too. Rows with a null page_id revisit the response that has their payload; if only such rows have it, they are
responses all. Payloads of any length are kept whole; an empty table gives no bundles. Other columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
BUNDLE_BYTES = 4 << 20
FRAME_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        head[6:6] = [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> dict:
    """A record's fields; ValueError if lengths or the payload's digest don't agree."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if tail != CRLF * 2:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(CRLF * 2)
    length = int(next(x for x in http.split(CRLF) if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("a payload doesn't match its record")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def bundle(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames (compressed, length before) and the seek table in a skippable frame at the end."""
    entries = b"".join(struct.pack("<II", len(c), n) for c, n in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(c for c, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed length, length) of each frame, from the footer."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    at, out = 0, []
    for c, n in struct.iter_unpack("<II", data[len(data) - 9 - 8 * count : len(data) - 9]):
        out.append((at, c, n))
        at += c
    return out


def frame_of(data: bytes, place: tuple[int, int, int]) -> bytes:
    """The records of the frame at a place of the seek table."""
    at, c, n = place
    return zstandard.ZstdDecompressor().decompress(data[at : at + c], max_output_size=max(n, 1))


def read_record(data: bytes, frame: int, offset: int, length: int) -> dict:
    """One record, from its frame alone."""
    return parse(frame_of(data, seek_table(data)[frame])[offset : offset + length])


def write_bundles(pages: DataFrame, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """A written table of bundles: data, and for the record of each of page_ids its frame, offset there and length."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    groups = keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Payloads that occur more than once, as a table: Spark knows its size and broadcasts it only below its own bound.
    shared = written(groups.where("n > 1").select("sha", "first_id"), "warc-shared")
    typed = keyed.join(shared, "sha", "left").select("page_id", "url", "html", F.expr("if(first_id = page_id, null, first_id)").alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        frames: list[tuple[bytes, int]] = []
        open_frame = bytearray()
        places: list[tuple[int | None, int, int, int]] = []

        def close() -> None:
            frames.append((compress(bytes(open_frame)), len(open_frame)))
            open_frame.clear()

        def emit() -> pa.RecordBatch:
            maps = [pa.array([[p[k] for p in places]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([bundle(frames)], pa.binary()), *maps], names=["data", "page_ids", "frames", "offsets", "lengths"])

        size = 0
        for batch in sliced(batches):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                raw = record(page_id, url, payload, digest_of(payload), refers_to)
                if open_frame and len(open_frame) + len(raw) > FRAME_BYTES:
                    close()
                    size += len(frames[-1][0])
                    if size >= BUNDLE_BYTES:
                        yield emit()
                        frames, places, size = [], [], 0
                places.append((page_id, len(frames), len(open_frame), len(raw)))
                open_frame += raw
        if open_frame:
            close()
            yield emit()

    return written(typed.mapInArrow(pack, "data binary, page_ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"), "warc-bundles")


def read_bundles(bundles: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row for each record, read through the seek table frame by frame."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    out = pa.schema(fields + [("payload", pa.binary())] * keep_payload)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4):
            for data, *maps in zip(*(batch.column(c).to_pylist() for c in ("data", "page_ids", "frames", "offsets", "lengths")), strict=True):
                places, rows, now, held = seek_table(data), [], -1, b""
                for page_id, frame, offset, length in zip(*maps, strict=True):
                    if frame != now:
                        now, held = frame, frame_of(data, places[frame])
                    found = parse(held[offset : offset + length])
                    if found["page_id"] != page_id:
                        raise ValueError("the map names another record")
                    rows.append(found)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in out.names} for r in rows], schema=out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * keep_payload
    return bundles.mapInArrow(unpack, schema)
