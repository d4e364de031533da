"""Media column in the Ogg container.

A payload of 8-bit unsigned mono samples becomes two multiplexed logical streams: the samples, one packet for each
frame of 576, and a comment stream with the lengths. Pages carry the container's checksum; the reader verifies it,
reassembles packets from lacing values, separates the streams by serial number and derives times from granule positions: a
page's is the end of the last packet that it ends, from which those before count back. Containers are stored as a column
of a table, which a second step reads.

Defined results: a null or empty text is one frame of the padding byte. Equal texts give equal bytes, whatever the row.
Texts of any length work; memory is that of one batch and of one text's container.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, documents, texts_of

FRAME = 576
RATE = 8000
PAD = b"\xff"
#: Serial numbers of the two logical streams.
SAMPLES, COMMENTS = 0x4C4F4445, 0x53544F4E
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, from 0 and not inverted.

    zlib's is the same polynomial with bits in the other order, so bytes go in reversed and the sum is turned round."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def lacing_of(length: int) -> bytes:
    """A packet's lacing values: 255 as often as it fits, then the rest, which may be 0."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """One logical stream's pages. packets: (bytes, granule position at its end). A packet may run over many pages."""
    out: list[bytes] = []
    lacing, body, granule, goes_on = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, goes_on
        flags = CONTINUED * goes_on | FIRST * (not out) | LAST * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, goes_on = bytearray(), bytearray(), NO_GRANULE, open_packet

    for packet, position in packets:
        values, at = lacing_of(len(packet)), 0
        if len(lacing) + len(values) > 255 and len(values) <= 255:
            flush(False, False)
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            lacing += part
            size = sum(part)
            body += packet[at : at + size]
            at += size
            if values:
                flush(False, True)
        granule = position
    flush(True, False)
    return out


def mux(payload: bytes, text_bytes: int) -> bytes:
    """The container of a payload whose length is a multiple of FRAME: header pages, then pages of both streams in turn."""
    head = struct.pack("<8sIHH", b"lodepcm8", RATE, 1, FRAME)
    samples = [(head, 0)] + [(payload[at : at + FRAME], at + FRAME) for at in range(0, len(payload), FRAME)]
    notes = [(b"lodenote", 0), (b"bytes=%d" % text_bytes, len(payload))]
    a, b = pages_of(samples, SAMPLES), pages_of(notes, COMMENTS)
    mixed = [a[0], *b, *a[1:]]
    return b"".join(mixed)


def demux(container: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """serial: packets, each page's last one with the page's granule position. ValueError if a page is damaged or missing."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    pending: dict[int, bytearray] = {}
    expected: dict[int, int] = {}
    at, size = 0, len(container)
    while at < size:
        if container[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        flags, granule, serial, sequence, crc, count = struct.unpack_from("<BqIIIB", container, at + 5)
        lacing = container[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        page = container[at : at + 22] + b"\0\0\0\0" + container[at + 26 : end]
        if page_checksum(page) != crc:
            raise ValueError(f"page at byte {at}: wrong checksum")
        if sequence != expected.get(serial, 0):
            raise ValueError(f"stream {serial:x}: page {expected.get(serial, 0)} is missing")
        expected[serial] = sequence + 1
        packets = streams.setdefault(serial, [])
        rest = pending.pop(serial, None)
        if (rest is not None) != bool(flags & CONTINUED):
            raise ValueError(f"stream {serial:x}: a packet is cut at page {sequence}")
        values = np.frombuffer(lacing, np.uint8).astype(np.int64)
        stops = np.cumsum(values)
        first, ended = start, False
        for k in np.flatnonzero(values < 255).tolist():
            last = start + int(stops[k])
            piece = container[first:last]
            packets.append((bytes(rest) + piece if rest is not None else piece, None))
            rest, first = None, last
            ended = True
        if ended:
            packets[-1] = (packets[-1][0], granule)
        if count and lacing[-1] == 255:
            pending[serial] = (rest if rest is not None else bytearray()) + container[first:end]
        at = end
    if pending:
        raise ValueError("a packet never ends")
    return streams


def ends_of(packets: list[tuple[bytes, int | None]], frame: int) -> list[int]:
    """The granule position at each packet's end: its page's, less a frame for each packet that follows on the page."""
    ends = [0] * len(packets)
    at = 0
    for i in range(len(packets) - 1, -1, -1):
        granule = packets[i][1]
        at = granule if granule is not None else at - frame
        ends[i] = at
    return ends


def read_back(container: bytes) -> tuple[bytes, int, np.ndarray, int]:
    """Payload, the text's bytes as noted, the granule position at the end of each packet of samples, samples a second.
    ValueError unless packets follow each other without a gap."""
    streams = demux(container)
    packets, notes = streams[SAMPLES], streams[COMMENTS]
    rate, _, frame = struct.unpack_from("<IHH", packets[0][0], 8)
    ends = np.array(ends_of(packets[1:], frame), dtype=np.int64)
    lengths = np.array([len(p) for p, _ in packets[1:]], dtype=np.int64)
    if not np.array_equal(ends, np.cumsum(lengths)):
        raise ValueError("granule positions don't follow the samples")
    return b"".join(p for p, _ in packets[1:]), int(notes[1][0].split(b"=")[1]), ends, rate


def features(payload: bytes, seconds: float) -> str:
    """Exact figures of the signal: duration, mean, peak to peak, mean square and zero crossings about mid-scale."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    above = x >= 0
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"ms={round(seconds * 1000)};sum={int(x.sum())};range={int(x.max() - x.min())};energy={int((x * x).sum())};crossings={crossings}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and media, the text's container."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [t.encode() for t in texts_of(batch)]
        media = [mux(raw + PAD * (-len(raw) % FRAME if raw else FRAME), len(raw)) for raw in raws]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return arrow_map(documents(docs), make, "doc_id long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """What reading the containers of a table (doc_id, media) gives."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            payload, n_bytes, ends, rate = read_back(media)
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, int(ends[-1]) / rate)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(stored.select("doc_id", "media"), make, schema)
