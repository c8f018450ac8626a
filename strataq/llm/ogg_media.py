"""Media columns: bytes in an Ogg container, written and read back (RFC 3533).

``mux`` stores samples in two logical streams that share one physical stream: packets of a payload go to
them in turn, each stream has a header packet, and pages are interleaved by time. ``demux`` verifies each
page's checksum, reassembles packets from lacing values (also across pages), separates the streams by
serial number and gives packets times from the granule positions.

A stream's setup packet names the packet length, so media of any packet length can be read back.

Defined cases: a null value counts as empty; damaged, truncated or foreign bytes raise ``OggError`` (or, with
``on_error='null'``, give null columns), null media give nulls; serial numbers derive from the payload, so equal values
have equal media. Values are taken whole, however long. An empty table gives no rows. Other columns pass through; one that is
named like an output (in any case) is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import quoted, slices, with_result

CAPTURE = b"OggS"
MAGIC = b"PCM8\0\2"
CONTINUED, FIRST, LAST = 1, 2, 4
RATE = 8000
PACKET = 4000
UNIT = 192
HEADER = struct.Struct("<4sBBqIIIB")
#: Magic, index of the stream, number of streams, samples a second, samples in all, samples of a packet.
SETUP = struct.Struct("<6sBBIQI")

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def page_crc(data: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, no inversion) by the mirrored CRC of zlib."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Writer:
    """Pages of one logical stream; a page ends at 255 segments."""

    serial: int
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    continued: bool = False

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Adds a packet and yields the pages that it fills."""
        at = 0
        left = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        while left:
            room = 255 - len(self.lacing)
            now, left = left[:room], left[room:]
            self.lacing += now
            size = sum(now)
            self.body.append(data[at : at + size])
            at += size
            if not left:
                self.granule = granule
            if len(self.lacing) == 255:
                yield self.page(continues=bool(left))

    def page(self, flags: int = 0, continues: bool = False) -> bytes:
        flags |= CONTINUED * self.continued
        body = b"".join(self.body)
        head = HEADER.pack(CAPTURE, 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        crc = page_crc(head + body)
        self.number += 1
        self.lacing, self.body, self.granule, self.continued = bytearray(), [], -1, continues
        return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def mux(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """One physical stream of two logical streams; packet k goes to stream k mod 2, its granule is the sample after it."""
    if packet < 1:
        raise OggError("a packet holds one sample at least")
    seed = zlib.crc32(payload)
    streams = [Writer(seed), Writer(seed ^ 0x5A5A5A5A)]
    out: list[bytes] = []
    for k, s in enumerate(streams):
        list(s.packet(SETUP.pack(MAGIC, k, len(streams), rate, len(payload), packet), 0))
        out.append(s.page(FIRST))
    for k, at in enumerate(range(0, len(payload), packet)):
        data = payload[at : at + packet]
        out += streams[k % 2].packet(data, at + len(data))
    out += [s.page(LAST) for s in streams]
    return b"".join(out)


@dataclass
class Media:
    """What ``demux`` found: the payload, and (serial, time in seconds, size) of each packet in order."""

    payload: bytes
    rate: int
    pages: int
    packets: list[tuple[int, float, int]]
    streams: int


def pages(data: bytes) -> Iterator[tuple[int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, lacing values, body) of each page, its checksum and number verified."""
    at, view, numbers = 0, memoryview(data), {}
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("truncated page header")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        if capture != CAPTURE or version:
            raise OggError("no page here")
        start = at + HEADER.size + count
        lacing = data[at + HEADER.size : start]
        end = start + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError("truncated page")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("checksum differs")
        if number != numbers.get(serial, -1) + 1:
            raise OggError("page lost")
        numbers[serial] = number
        yield flags, granule, serial, lacing, view[start:end]
        at = end


def demux(data: bytes) -> Media:
    parts: dict[int, list[memoryview]] = {}
    info: dict[int, tuple[int, int, int, int, int]] = {}
    found: list[tuple[int, int, bytes]] = []
    waiting: dict[int, list[int]] = {}
    ended: set[int] = set()
    n_pages = 0
    for flags, granule, serial, lacing, body in pages(data):
        n_pages += 1
        if bool(flags & FIRST) != (serial not in parts) or serial in ended:
            raise OggError("stream begins twice, or not at all")
        if bool(flags & CONTINUED) != bool(parts.get(serial)):
            raise OggError("packet continues without its beginning")
        own = parts.setdefault(serial, [])
        ends, at = waiting.setdefault(serial, []), 0
        size = 0
        for v in lacing:
            size += v
            if v < 255:
                own.append(body[at : at + size])
                packet = b"".join(own)
                own.clear()
                at, size = at + size, 0
                if serial not in info:
                    magic, *fields = SETUP.unpack(packet) if len(packet) == SETUP.size else (b"",)
                    if magic != MAGIC:
                        raise OggError("unknown stream")
                    info[serial] = tuple(fields)
                else:
                    ends.append(len(found))
                    found.append((serial, -1, packet))
        if size:
            own.append(body[at : at + size])
        if granule >= 0 and ends:  # the last packet that ends here ends at the granule; earlier ones count back
            n, room = info[serial][1], info[serial][4]
            gap = granule
            for k in reversed(ends):
                found[k] = (serial, gap, found[k][2])
                gap -= len(found[k][2]) + (n - 1) * room  # between a stream's packets lie those of the others
            ends.clear()
        if flags & LAST:
            ended.add(serial)
    if not info or ended != set(info) or any(parts.values()) or any(waiting.values()):
        raise OggError("stream without its end")
    rate, total = next(iter(info.values()))[2:4]
    found.sort(key=lambda x: (x[1], info[x[0]][0]))
    payload = b"".join(x[2] for x in found)
    if len(payload) != total or any(g != e for (_, g, p), e in zip(found, np.cumsum([len(x[2]) for x in found]))):
        raise OggError("samples lost")
    return Media(payload, rate, n_pages, [(s, (g - len(p)) / rate, len(p)) for s, g, p in found], len(info))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Spaces up to a positive multiple of ``unit``."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def feature(m: Media) -> str:
    """Summary of the samples read back: streams, packets, duration, mean and spread of levels about 128."""
    x = np.frombuffer(m.payload, np.uint8).astype(np.int64)
    n = max(1, len(x))
    mean = int(x.sum()) / n
    spread = max(0.0, int((x * x).sum()) / n - mean * mean) ** 0.5
    last = m.packets[-1][1] if m.packets else 0.0
    return f"streams={m.streams};packets={len(m.packets)};seconds={len(x) / m.rate:.6f};last={last:.6f};mean={mean:.4f};spread={spread:.4f}"


def encode_media(df: DataFrame, text: str = "text", unit: int = UNIT) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8 bytes of the text) and ``media`` (binary; the padded bytes in Ogg)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (x for batch in batches for x in slices(batch)):
            raw = [(t or "").encode() for t in texts]
            yield pa.StructArray.from_arrays([pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x, unit)) for x in raw], pa.binary())], ["n_bytes", "media"])

    return with_result(df, F.arrow_udf(run, "struct<n_bytes:long,media:binary>")(quoted(text)), ["n_bytes", "media"])


READ = "struct<payload:binary,feature:string,pages:int,packet_times:array<double>,packet_serials:array<long>>"


def decode_media(df: DataFrame, media: str = "media", on_error: str = "raise") -> DataFrame:
    """``df`` with the payload read back from ``media``, its feature, number of pages, and each packet's time
    and stream. Null media give nulls."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in (x for batch in batches for x in slices(batch)):
            rows = []
            for data in values:
                try:
                    m = None if data is None else demux(data)
                except OggError:
                    if on_error != "null":
                        raise
                    m = None
                rows.append(m and (m.payload, feature(m), m.pages, [x[1] for x in m.packets], [x[0] for x in m.packets]))
            cols = [[r and r[k] for r in rows] for k in range(5)]
            kinds = [pa.binary(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["payload", "feature", "pages", "packet_times", "packet_serials"])

    return with_result(df, F.arrow_udf(run, READ)(quoted(media)), ["payload", "feature", "pages", "packet_times", "packet_serials"])


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
