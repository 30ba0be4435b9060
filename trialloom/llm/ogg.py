"""Media columns: Ogg files made from and read back into bytes.

A file multiplexes logical streams into pages; a page has a checksum, a granule position
and lacing values that say how its bytes fall into packets. The sample stream holds
8-bit samples and its granule positions count them, so time is granule / rate; a second
stream of notes holds the number of unpadded bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow

HEADER = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, sequence, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, NOTES = 1, 2  # serial numbers
RATE = 8000
PACKET = 4096
ALIGN = 64

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The CRC of a page (polynomial 04c11db7, highest bit first, from 0, not inverted).

    zlib's CRC has the same polynomial, lowest bit first: reversing the bits of the
    input bytes and of the result leads from one to the other.
    """
    low = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Writer:
    """Pages of one logical stream."""

    serial: int
    sequence: int = 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool) -> Iterator[bytes]:
        """Pages of packets, each with the granule position at its end; a packet of any
        length goes on over as many pages as it needs."""
        segments: list[tuple[bytes, int | None]] = []
        for data, granule in packets:
            cuts = [data[at : at + 255] for at in range(0, len(data), 255)]
            if len(data) % 255 == 0:
                cuts.append(b"")
            segments += [(c, None) for c in cuts[:-1]] + [(cuts[-1], granule)]
        open_ = False
        for at in range(0, len(segments), 255):
            part = segments[at : at + 255]
            ends = [g for _, g in part if g is not None]
            flags = CONTINUED * open_ | FIRST * (self.sequence == 0) | LAST * (last and at + 255 >= len(segments))
            head = HEADER.pack(b"OggS", 0, flags, ends[-1] if ends else -1, self.serial, self.sequence, 0, len(part))
            page = head + bytes(len(c) for c, _ in part) + b"".join(c for c, _ in part)
            yield page[:22] + struct.pack("<I", checksum(page)) + page[26:]
            self.sequence += 1
            open_ = part[-1][1] is None


def encode(payload: bytes, note: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of payload as 8-bit samples, and of one note in a stream beside it."""
    samples, notes = Writer(SAMPLES), Writer(NOTES)
    out = [*samples.pages([(b"PCM8" + struct.pack("<I", rate), 0)], False), *notes.pages([(b"NOTE", 0)], False)]
    packets = [(payload[at : at + packet], min(at + packet, len(payload))) for at in range(0, len(payload), packet)]
    half = len(packets) // 2
    if half:
        out += samples.pages(packets[:half], False)
    out += notes.pages([(note, len(note))], True)
    out += samples.pages(packets[half:], True)
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (packets so far, granule) of pages that end one
    next: int = 0
    open: bytearray | None = None
    first: bool = False
    last: bool = False


def read(media: bytes) -> tuple[dict[int, Stream], list[str]]:
    """Logical streams by serial number, and what is wrong with the file.

    A page with a wrong checksum is left out whole, and so is the packet that it breaks.
    """
    streams: dict[int, Stream] = {}
    errors, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + HEADER.size > len(media):
            errors.append(f"no page at {at}")
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            errors.append(f"bad page at {at}")
            at += 1
            continue
        s = streams.setdefault(serial, Stream())
        if sequence != s.next:
            errors.append(f"stream {serial} lacks pages {s.next} to {sequence - 1}")
            s.open = None
        s.next = sequence + 1
        s.first |= bool(flags & FIRST)
        s.last |= bool(flags & LAST)
        body, before = at + 27 + n, len(s.packets)
        part = s.open if flags & CONTINUED else bytearray()
        if flags & CONTINUED and part is None:
            errors.append(f"stream {serial} goes on with a lost packet")
        for size in lacing:
            if part is not None:
                part += media[body : body + size]
            body += size
            if size < 255:
                if part is not None:
                    s.packets.append(bytes(part))
                part = bytearray()
        s.open = part if n and lacing[-1] == 255 else None
        if granule >= 0 and len(s.packets) > before:
            s.ends.append((len(s.packets), granule))
        at = end
    errors += [f"stream {k} has no {what}" for k, s in streams.items() for what, there in (("first page", s.first), ("last page", s.last)) if not there]
    return streams, errors


def features(payload: bytes, stream: Stream, rate: int) -> str:
    """Duration and packet times from granule positions, and plain statistics of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    share = np.bincount(x + 128, minlength=256) / max(1, len(x))
    bits = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    times = "/".join(f"{g / rate:.6f}" for _, g in stream.ends[-3:])
    energy = float((x.astype(np.float64) ** 2).mean()) ** 0.5 if len(x) else 0.0
    return f"seconds={stream.ends[-1][1] / rate:.6f};packets={len(stream.packets) - 1};ends={times};rms={energy:.6f};crossings={crossings};entropy={bits:.6f}"


def padded(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % ALIGN if raw else ALIGN)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): an Ogg file for each row. Null texts count as empty; null
    ids and repeated rows keep their rows, no rows give none; other columns are not read."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            media = [encode(payload, struct.pack("<q", n)) for n, payload in map(padded, b["text"])]
            yield {"doc_id": b["doc_id"], "media": media}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """What each Ogg file holds: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, errors. A null or damaged file keeps its row: its
    payload is what could be read, and errors says what is wrong (empty: nothing)."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "errors")

    def one(doc_id, data: bytes | None) -> tuple:
        data = data or b""
        streams, errors = read(data)
        stream, notes = streams.get(SAMPLES, Stream()), streams.get(NOTES, Stream())
        payload, n_bytes, feature = b"".join(stream.packets[1:]), None, None
        if len(notes.packets) > 1 and len(notes.packets[1]) == 8:
            n_bytes = struct.unpack("<q", notes.packets[1])[0]
        if stream.packets and len(stream.packets[0]) == 8 and stream.ends:
            feature = features(payload, stream, struct.unpack("<I", stream.packets[0][4:])[0])
            if stream.ends[-1][1] != len(payload):
                errors.append("granule position differs from the samples")
        else:
            errors.append("no sample stream")
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature, "; ".join(errors)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [one(d, m) for d, m in zip(b["doc_id"], b["media"], strict=True)]
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(media.select("doc_id", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, errors string")
