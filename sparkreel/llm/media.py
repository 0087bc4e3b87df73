"""Media columns in Ogg: text bytes as 8-bit samples in pages, and back.

A file has two logical streams. The sample stream holds frames of 576 samples,
one to a packet. The mark stream has a packet for every sample page: the first
sample, the number of samples and their CRC. Each begins with a header packet on
a page of its own. Granule positions count samples at the end of the last packet
that a page completes.

Reading checks page checksums and sequence numbers, reassembles packets from
lacing values across pages, tells logical streams apart by serial number, and
derives packet times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 8000
SAMPLES, MARKS = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_MARK = struct.Struct("<qII")
_SAMPLE_HEADER = b"\x01pcm8" + struct.pack("<IH", RATE, FRAME)
_MARK_HEADER = b"\x01mark"
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class Broken(ValueError):
    """Bytes that are no whole Ogg file."""


class Packet(NamedTuple):
    data: bytes
    #: Granule position after the packet; None if its page names none for it.
    granule: int | None


def checksum(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0: the mirror image of zlib's."""
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


class Stream:
    """Pages of one logical stream, from packets with the granule position after each."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], last: bool = False) -> list[bytes]:
        """A packet goes on on the next page where 255 lacing values are not enough."""
        lacing = b"".join(b"\xff" * (len(data) // 255) + bytes([len(data) % 255]) for data, _ in packets)
        body = b"".join(data for data, _ in packets)
        done, ends = {}, 0
        for data, granule in packets:
            ends += len(data) // 255 + 1
            done[ends - 1] = granule
        out, at, continued = [], 0, False
        for start in range(0, len(lacing), 255):
            values = lacing[start : start + 255]
            granule = max((done[i] for i in range(start, start + len(values)) if i in done), default=-1)
            end = last and start + 255 >= len(lacing)
            flags = CONTINUED * continued | FIRST * (self.number == 0) | LAST * end
            size = sum(values)
            out.append(page(self.serial, self.number, flags, granule, values, body[at : at + size]))
            at, self.number, continued = at + size, self.number + 1, values[-1] == 255
        return out


#: Frames of a full page: three lacing values each.
_FRAMES = 255 // (FRAME // 255 + 1)


def store(payload: bytes) -> bytes:
    """An Ogg file with payload, whose length is a positive multiple of FRAME."""
    samples, marks = Stream(SAMPLES), Stream(MARKS)
    out = samples.pages([(_SAMPLE_HEADER, 0)]) + marks.pages([(_MARK_HEADER, 0)])
    step = _FRAMES * FRAME
    for start in range(0, len(payload), step):
        part = payload[start : start + step]
        end = start + step >= len(payload)
        out += samples.pages([(part[i : i + FRAME], start + i + FRAME) for i in range(0, len(part), FRAME)], end)
        out += marks.pages([(_MARK.pack(start, len(part), zlib.crc32(part)), start + len(part))], end)
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(serial, number, flags, granule, lacing, body) of each page; Broken unless all bytes are whole pages."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise Broken("cut page header")
        capture, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if capture != b"OggS" or version:
            raise Broken(f"no page at byte {at}")
        lacing = data[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise Broken("cut page")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise Broken(f"page checksum at byte {at}")
        yield serial, number, flags, granule, lacing, view[at + _HEAD.size + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[Packet]]:
    """Packets of each logical stream by serial number."""
    streams: dict[int, list[Packet]] = {}
    state: dict[int, tuple[int, list, bool]] = {}
    for serial, number, flags, granule, lacing, body in pages(data):
        following, rest, ended = state.get(serial, (0, [], False))
        if number != following or ended or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(rest):
            raise Broken(f"page {number} of stream {serial} out of place")
        packets, at, start = streams.setdefault(serial, []), 0, 0
        for value in lacing:
            at += value
            if value < 255:
                packets.append(Packet(b"".join([*rest, body[start:at]]), None))
                rest, start = [], at
        if start < len(body):
            rest = [*rest, body[start:]]
        if packets and granule != -1:
            packets[-1] = packets[-1]._replace(granule=granule)
        state[serial] = (number + 1, rest, bool(flags & LAST))
    if any(rest or not ended for _, rest, ended in state.values()):
        raise Broken("stream without an end")
    return streams


def timed(packets: list[Packet]) -> list[tuple[int, bytes]]:
    """(first sample, data) of sample packets: positions run back from the granules that pages name."""
    out, end = [], None
    for packet in reversed(packets):
        end = packet.granule if packet.granule is not None else end
        if end is None or end < len(packet.data):
            raise Broken("packet without a position")
        end -= len(packet.data)
        out.append((end, packet.data))
    return out[::-1]


def read(data: bytes) -> tuple[bytes, list[int]]:
    """(payload, start of each packet in milliseconds), checked against the mark stream."""
    streams = demultiplex(data)
    head, *packets = streams.get(SAMPLES, [Packet(b"", None)])
    mark_head, *marks = streams.get(MARKS, [Packet(b"", None)])
    if head.data != _SAMPLE_HEADER or mark_head.data != _MARK_HEADER:
        raise Broken("unknown streams")
    placed = timed(packets)
    payload = b"".join(part for _, part in placed)
    if [at for at, _ in placed] != list(range(0, len(payload), FRAME)):
        raise Broken("gap between packets")
    for mark in marks:
        start, n, crc = _MARK.unpack(mark.data)
        if zlib.crc32(payload[start : start + n]) != crc:
            raise Broken(f"samples from {start} differ from their mark")
    return payload, [at * 1000 // RATE for at, _ in placed]


def payload_of(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of FRAME."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b"\xff")


def features(payload: bytes, starts: list[int]) -> str:
    """Frames, milliseconds, mean, root mean square, crossings of the middle level, loudest frame."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    power = (samples.reshape(-1, FRAME) ** 2).sum(axis=1)
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    loudest = starts[int(power.argmax())]
    return f"frames={len(starts)};ms={len(payload) * 1000 // RATE};mean={int(samples.sum()) // len(samples)};rms={int((int(power.sum()) // len(samples)) ** 0.5)};crossings={crossings};loudest_ms={loudest}"


def _store_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
        for start in range(0, len(batch), 256):
            part = texts.slice(start, 256)
            files = [store(payload_of(x.as_py() or b"")) for x in part]
            sizes = [len(x.as_py() or b"") for x in part]
            yield pa.record_batch([ids.slice(start, 256), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the Ogg file of every row's text. Null counts as empty; equal texts give equal files."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store_task, "doc_id long, n_bytes long, media binary")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    for batch in batches:
        rows = []
        for n, media in zip(batch.column("n_bytes"), batch.column("media"), strict=True):
            data = media.as_py()
            try:
                payload, starts = read(data if data is not None else b"")
                rows.append((n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, starts), None))
            except Broken as error:
                rows.append((n.as_py(), None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, str(error)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    media(doc_id, n_bytes, media) is read back from its bytes alone. A file that is
    broken or null has an error, and null for all that would come from its payload.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def _page_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i.as_py(), s, n, f, g, len(lacing), len(body)) for i, m in zip(batch.column("doc_id"), batch.column("media"), strict=True) for s, n, f, g, lacing, body in pages(m.as_py() or b"")]
        kinds = [("doc_id", pa.int64()), ("serial", pa.int64()), ("number", pa.int64()), ("flags", pa.int32()), ("granule", pa.int64()), ("segments", pa.int32()), ("body_bytes", pa.int64())]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])


def page_table(media: DataFrame) -> DataFrame:
    """One row for each page of media(doc_id, media): its stream, number, flags and granule position."""
    return media.select("doc_id", "media").mapInArrow(_page_task, "doc_id long, serial long, number long, flags int, granule long, segments int, body_bytes long")
