"""Ogg media columns: page checksums, packets from lacing values, logical streams, granule timestamps.

A payload is stored as unsigned 8-bit samples in two multiplexed logical PCM streams: packets of 576
samples go to them in turn, and each page's granule position is the payload's sample count at the end
of the last packet that ends on it. Reading verifies every page's CRC, joins lacing segments over page
borders, sorts pages into streams by serial number, dates packets from granule positions and merges the
streams by time.

Defined cases: a null text is the empty text; an empty payload is one packet of 255s; equal texts give
equal media; corrupt media give a null payload and a reason in `error`, and never fail the job; a very long
text is one recording, held whole; repeated rows are each stored; packets never tie, as each has its time; an
empty table gives no rows; other columns pass through untouched, save one of the media column's name, which is
replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_rows, slices

PACKET = 576
RATE = 8000
#: Lacing values a page holds at most; 100 is no multiple of a packet's three, so packets span pages.
SEGMENTS = 100
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """A stream that breaks the format, or fails a checksum."""


def crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, no reflection, start 0), by zlib's reflected one over reversed bits."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda c: _HEADER.pack(b"OggS", 0, flags, granule, serial, number, c, len(lacing)) + lacing
    return head(crc(head(0) + body)) + body


def _lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def _headers(serial: int) -> list[bytes]:
    """The two header pages of a PCM stream: identification, then comments."""
    identity = struct.pack("<8sHHIIBBHI", b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    comments = struct.pack("<I", 4) + b"tide" + struct.pack("<I", 0)
    return [_page(_FIRST, 0, serial, 0, _lacing(len(identity)), identity), _page(0, 0, serial, 1, _lacing(len(comments)), comments)]


def pad(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a packet; UTF-8 never holds 255, so the text's end stays known."""
    return text + b"\xff" * (max(PACKET, -(-len(text) // PACKET) * PACKET) - len(text))


def encode(payload: bytes) -> bytes:
    """A payload of whole packets as one multiplexed Ogg file."""
    packets = np.frombuffer(payload, np.uint8).reshape(-1, PACKET)
    pattern = _lacing(PACKET)
    out, timed = [], []
    for serial in (1, 2):
        own = packets[serial - 1 :: 2]
        head = _headers(serial)
        out.append(head[0])
        timed.append((0, serial, head[1]))
        data, lacing = own.tobytes(), pattern * len(own)
        done = at = 0
        pages = range(0, len(lacing), SEGMENTS)
        for k, first in enumerate(pages):
            part = lacing[first : first + SEGMENTS]
            size = sum(part)
            ended = part.count(pattern[-1])  # packets end with the one value below 255
            continued = first % len(pattern) != 0
            done += ended
            granule = PACKET * (2 * (done - 1) + serial) if ended else -1
            flags = _CONTINUED * continued | _LAST * (k == len(pages) - 1)
            timed.append((granule, serial, _page(flags, granule, serial, k + 2, part, data[at : at + size])))
            at += size
        if not len(own):
            timed.append((0, serial, _page(_LAST, 0, serial, 2, b"", b"")))
    return b"".join(out + [page for _, _, page in sorted(timed, key=lambda x: x[0])])


@dataclass
class Packet:
    """One packet of a logical stream; start is in samples, None for headers."""

    serial: int
    number: int
    data: bytes
    start: int | None = None


@dataclass
class _Stream:
    pages: int = 0
    packets: int = 0
    partial: bytes | None = None
    granule: int = 0
    ended: bool = False


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of every page; raises on a bad checksum or a gap."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise OggError("truncated page header")
        magic, version, flags, granule, serial, number, want, count = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        table = at + _HEADER.size
        lacing = media[table : table + count]
        end = table + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("truncated page")
        if crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != want:
            raise OggError(f"checksum of page {number} of stream {serial}")
        yield flags, granule, serial, number, lacing, media[table + count : end]
        at = end


def demultiplex(media: bytes) -> tuple[list[Packet], dict[int, _Stream]]:
    """Every packet with its stream and start time, and what was seen of each stream."""
    streams: dict[int, _Stream] = {}
    found: list[Packet] = []
    for flags, granule, serial, number, lacing, body in pages(media):
        s = streams.setdefault(serial, _Stream())
        if number != s.pages or bool(flags & _FIRST) != (number == 0) or s.ended:
            raise OggError(f"page {number} of stream {serial} out of sequence")
        if bool(flags & _CONTINUED) != (s.partial is not None):
            raise OggError(f"page {number} of stream {serial} breaks a packet")
        s.pages += 1
        s.ended = bool(flags & _LAST)
        own: list[Packet] = []
        at = start = 0
        held = s.partial or b""
        for value in lacing:
            at += value
            if value < 255:
                own.append(Packet(serial, s.packets, held + body[start:at]))
                s.packets += 1
                held, start = b"", at
        open_ = bool(lacing) and lacing[-1] == 255
        s.partial = held + body[start:] if open_ else None
        if own and own[-1].number >= 2:  # data: the page's granule is the end of its last packet
            step = 2 * PACKET
            for back, packet in enumerate(reversed(own)):
                if packet.number >= 2:
                    packet.start = granule - PACKET - back * step
            s.granule = granule
        found += own
    for serial, s in streams.items():
        if s.partial is not None or not s.ended:
            raise OggError(f"stream {serial} is cut off")
    return found, streams


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload in time order, and features of the recording."""
    packets, streams = demultiplex(media)
    data = sorted((p for p in packets if p.start is not None), key=lambda p: p.start)
    if any(p.start != k * PACKET for k, p in enumerate(data)):
        raise OggError("timestamps leave a gap")
    payload = b"".join(p.data for p in data)
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean()) if x.size else 0.0
    rms = float(np.sqrt(np.square(x.astype(np.float32) - 128).mean(dtype=np.float64))) if x.size else 0.0
    seen = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(data),
            "end_ms": max((s.granule for s in streams.values()), default=0) * 1000 // RATE, "mean": round(mean, 3), "rms": round(rms, 3)}
    return payload, seen


_MEDIA_FEATURES = ["streams", "pages", "packets", "end_ms", "mean", "rms"]


def _encode_batches(batches: Iterator[pa.RecordBatch], at: int, kept: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(at).to_pylist()
        media = pa.array([encode(pad((t or "").encode())) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), media], names=names)


def with_media(df: DataFrame, text: str, out: str = "media") -> DataFrame:
    """df and a binary column `out` that stores the text's padded UTF-8 bytes."""
    kept = [k for k, f in enumerate(df.schema.fields) if f.name.lower() != out.lower()]
    schema = T.StructType([*(df.schema.fields[k] for k in kept), T.StructField(out, T.BinaryType())])
    return df.mapInArrow(partial(_encode_batches, at=df.columns.index(text), kept=kept, names=schema.names), schema)


def _read_one(doc_id, media):
    try:
        payload, f = decode(media)
    except OggError as bad:
        return (doc_id, None, len(media), hashlib.sha256(media).hexdigest(), None, str(bad))
    return (doc_id, payload, len(media), hashlib.sha256(media).hexdigest(), ";".join(f"{k}={f[k]}" for k in _MEDIA_FEATURES), None)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, payload, media_bytes, media_sha256, feature and error of each stored recording."""
    schema = pa.schema([(key, pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
    return map_rows(df.select(key, media), lambda: lambda k, m: _read_one(k, m if m is not None else b""), schema)


def digests(read: DataFrame) -> DataFrame:
    """What the media query returns of recordings read back; built-in functions over the payload."""
    text = F.length(F.rtrim(F.decode("payload", "ISO-8859-1"), F.lit("ÿ")))
    tail = F.crc32(F.substring("payload", -32, 32))
    return read.select("doc_id", text.cast("long").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                       tail.cast("long").alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "error")
