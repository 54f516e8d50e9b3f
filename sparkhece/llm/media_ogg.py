"""Media columns: Ogg bitstreams written, verified, demultiplexed and timed.

Pages carry the 27-byte header of RFC 3533: capture pattern, flags, 64-bit granule position,
stream serial, sequence number, CRC (polynomial 0x04C11DB7, unreflected, zero start) and the
lacing table. ``demux`` checks every page's checksum and sequence number, rebuilds packets
from lacing values across page ends, and separates interleaved logical streams.

Defined results: null text is the empty text; an empty text is stored as one padded unit;
text of any length is stored whole (packets span as many pages as needed). Damaged pages
raise ``ValueError`` in ``demux``; the DataFrame operator reports them as ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576  # bytes of payload in one packet, and the unit that padding fills
RATE = 8000  # 8-bit samples a second
HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The Ogg checksum of a page whose checksum field is zero.

    The unreflected CRC of some bytes is the bit-reversed reflected CRC of the bit-reversed
    bytes, so zlib's routine computes it; its two inversions are undone.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    """A logical stream: packets, the page on which each ends and its granule position."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    page_of: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def _page(serial: int, seq: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    start = HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing)) + lacing
    crc = page_crc(start + body)
    return start[:22] + crc.to_bytes(4, "little") + start[26:] + body


def paginate(serial: int, packets: list[bytes], granules: list[int], segments: int = 255) -> list[bytes]:
    """Pages of one logical stream; packets go on over page ends where the lacing table is full."""
    pages: list[bytes] = []
    lacing, body, granule, goes_on = bytearray(), bytearray(), -1, False
    last = len(packets) - 1
    for i, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        n = len(packet)
        values = [255] * (n // 255) + [n % 255]
        at = 0
        for k, v in enumerate(values):
            lacing.append(v)
            body += packet[at : at + v]
            at += v
            done = k == len(values) - 1
            if done:
                granule = end
            final = done and i == last
            if len(lacing) == segments or final or (done and i == 0):  # the header packet has a page of its own
                flags = goes_on | (2 if not pages else 0) | (4 if final else 0)
                pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
                lacing, body, granule, goes_on = bytearray(), bytearray(), -1, not done
    return pages


def mux(streams: dict[int, tuple[list[bytes], list[int]]]) -> bytes:
    """Logical streams interleaved page by page (beginning pages first)."""
    paged = [paginate(serial, *s) for serial, s in streams.items()]
    out = [p[0] for p in paged]
    for k in range(1, max(map(len, paged), default=0)):
        out += [p[k] for p in paged if k < len(p)]
    return b"".join(out)


def demux(data: bytes) -> dict[int, Stream]:
    """Verify all pages and give back the packets of each logical stream."""
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, seq, crc, n = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one should begin")
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("truncated page")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of page {seq} of stream {serial} is wrong")
        s = streams.setdefault(serial, Stream())
        if s.pages != seq or bool(flags & 2) != (seq == 0) or s.ended:
            raise ValueError(f"page {seq} of stream {serial} is out of order")
        if bool(flags & 1) != (serial in partial):
            raise ValueError("continuation flag does not fit the page before")
        part = partial.pop(serial, bytearray())
        opened = bool(flags & 1)
        for v in lacing:
            part += data[body_at : body_at + v]
            body_at += v
            opened = True
            if v < 255:
                s.packets.append(bytes(part))
                s.granules.append(granule)
                s.page_of.append(s.pages)
                part, opened = bytearray(), False
        if opened:
            partial[serial] = part
        s.pages += 1
        s.ended = bool(flags & 4)
        at = end
    if partial or any(not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def packet_times(stream: Stream, rate: int = RATE) -> list[float]:
    """Seconds at which each packet ends; the header packet ends at 0.

    A page's granule position belongs to the last packet that ends in it. Earlier packets of
    the page are dated back from it by the sizes of those that follow (a byte is a sample).
    """
    times: list[float] = []
    later, page = 0, None
    for i in reversed(range(len(stream.packets))):
        later = 0 if stream.page_of[i] != page else later
        page = stream.page_of[i]
        times.append(max(0, stream.granules[i] - later) / rate)
        later += len(stream.packets[i])
    return times[::-1]


def payload_of(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """Length in UTF-8 and the bytes padded by 255 up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def store(payload: bytes, unit: int = UNIT) -> bytes:
    """A payload as Ogg: even units in stream 1, odd units in stream 2, interleaved by page.

    Each stream begins with a header packet (magic, unit, rate, samples of the payload).
    Granule positions count the samples of the own stream up to the packet's end.
    """
    units = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    streams = {}
    for serial in (1, 2):
        own = range(serial - 1, len(units), 2)
        head = b"RAW8" + struct.pack("<IIQ", unit, RATE, len(payload))
        streams[serial] = ([head, *(units[i] for i in own)], [0, *((k + 1) * unit for k in range(len(own)))])
    return mux(streams)


def load(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload of ``store`` and the streams that held it."""
    streams = demux(media)
    total = struct.unpack("<IIQ", streams[1].packets[0][4:])[2]
    even, odd = streams[1].packets[1:], streams[2].packets[1:]
    out = [b""] * (len(even) + len(odd))
    out[0::2], out[1::2] = even, odd
    payload = b"".join(out)
    if len(payload) != total:
        raise ValueError("samples are missing")
    return payload, streams


def features(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration from the last granule position, pages and packets per stream, signal figures."""
    import numpy as np

    x = np.frombuffer(payload, dtype=np.uint8)
    last = max(packet_times(s)[-1] for s in streams.values())
    low = int(np.count_nonzero(x < 128))
    step = int(np.count_nonzero(np.diff((x >= 110).view(np.int8)))) if len(x) else 0
    total = int(x.sum(dtype=np.int64))
    shape = ",".join(f"{k}:{s.pages}p{len(s.packets)}k" for k, s in sorted(streams.items()))
    return f"dur={last:.3f};streams={shape};mean={total / len(x):.4f};low={low / len(x):.4f};cross={step}"


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            n, payload = payload_of(text)
            media = store(payload)
            try:
                back, streams = load(media)
            except ValueError as e:
                rows.append((n, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e)))
                continue
            rows.append((
                n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), features(back, streams), None,
            ))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])


def media_digest(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Store each text as Ogg, read it back, and add a struct of digests and features."""
    return df.withColumn(out, F.pandas_udf(_digest, _SCHEMA)(F.col(text_col)))


def _stored(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: store(payload_of(t)[1]))


def media_column(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """The Ogg bytes themselves, for pipelines that keep the media."""
    return df.withColumn(out, F.pandas_udf(_stored, "binary")(F.col(text_col)))
