"""Records of containers, walked from any record's start over bytes that are in memory or in a file.

A walk reads a record's header, and its payload only if it is wanted; else it
goes past it. It starts at a place where a record begins, gives every record that
begins before `stop`, and returns where the next one begins: None if the file, or
the part of it that can be read, is over.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from typing import Protocol

#: Bytes of a payload that come with the header, for the fields of the codec.
LEAD = 16

#: (at, code, size, ms, header and lead, payload, error)
Record = tuple[int, int | None, int | None, int | None, bytes, bytes, str | None]
Walk = Generator[Record, None, int | None]


class Bytes(Protocol):
    size: int

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place."""

    def find(self, marker: bytes, at: int) -> int:
        """The first place of a marker from `at` on, or -1."""


class Held:
    """Bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def find(self, marker: bytes, at: int) -> int:
        return self.data.find(marker, at)


def every(code: int) -> bool:
    return True


def none(code: int) -> bool:
    return False


class Container:
    """A format: where its first record is, the walk, a guess where records go on inside a range, what each code's time is."""

    name: str

    @staticmethod
    def begin(source: Bytes) -> Walk:
        raise NotImplementedError

    @staticmethod
    def walk(source: Bytes, at: int, stop: int, wanted: Callable[[int], bool]) -> Walk:
        raise NotImplementedError

    @staticmethod
    def guess(source: Bytes, low: int, high: int) -> int | None:
        raise NotImplementedError

    @staticmethod
    def after(record: Record) -> int:
        """Where a whole record ends."""
        raise NotImplementedError

    @staticmethod
    def resume(source: Bytes, at: int) -> int | None:
        """Where the first record from the end of another one on begins; None if that is not there yet."""
        raise NotImplementedError

    @classmethod
    def whole(cls, source: Bytes, wanted: Callable[[int], bool] = every) -> Walk:
        at = yield from cls.begin(source)
        if at is not None:
            at = yield from cls.walk(source, at, source.size, wanted)
        return at


class Flv(Container):
    """Tags of a type, a size and a time, each after the size of the tag before."""

    name = "flv"

    @staticmethod
    def begin(source: Bytes) -> Walk:
        data = source.get(0, 9)
        if len(data) < 9 or data[:3] != b"FLV" or data[3] != 1 or int.from_bytes(data[5:9], "big") != 9:
            yield 0, None, None, None, data, b"", "no FLV header"
            return None
        return 9

    @staticmethod
    def walk(source: Bytes, at: int, stop: int, wanted: Callable[[int], bool]) -> Walk:
        while at < stop and at + 4 < source.size:
            head = source.get(at + 4, 11 + LEAD)
            if len(head) < 11:
                yield at, None, None, None, head, b"", "cut tag"
                return None
            kind, size = head[0] & 0x1F, int.from_bytes(head[1:4], "big")
            ms, end = int.from_bytes(head[4:7], "big") | head[7] << 24, at + 15 + size
            error = "reserved bits" if head[0] & 0xC0 else "cut tag" if end > source.size else None
            yield at, kind, size, ms, head[: 11 + size], source.get(at + 15, size) if wanted(kind) else b"", error
            if error:
                return None
            at = end
        return at if at + 4 < source.size else None

    @staticmethod
    def after(record: Record) -> int:
        return record[0] + 15 + record[2]

    @staticmethod
    def resume(source: Bytes, at: int) -> int | None:
        return at if at + 15 <= source.size else None

    @staticmethod
    def guess(source: Bytes, low: int, high: int) -> int | None:
        """The first place where a tag may stand whose size agrees with the size after it."""
        import numpy as np

        step = 1 << 16
        for start in range(low, high, step):
            data = np.frombuffer(source.get(start, min(step, high - start) + 15), np.uint8)
            n = min(len(data) - 14, high - start)
            if n <= 0:
                continue
            likely = np.isin(data[4 : 4 + n], (8, 9, 18)) & (data[12 : 12 + n] == 0) & (data[13 : 13 + n] == 0) & (data[14 : 14 + n] == 0)
            for place in np.flatnonzero(likely).tolist():
                size = int.from_bytes(data[place + 5 : place + 8].tobytes(), "big")
                end = start + place + 15 + size
                if end == source.size or source.get(end, 4) == (11 + size).to_bytes(4, "big"):
                    return start + place
        return None


class ProgramStream(Container):
    """Packs, system headers and packets, each with a start code; what stands between them is passed over."""

    name = "mpegps"
    mark = b"\x00\x00\x01"

    @classmethod
    def begin(cls, source: Bytes) -> Walk:
        at = source.find(cls.mark, 0)
        return at if at >= 0 else None
        yield

    @classmethod
    def walk(cls, source: Bytes, at: int, stop: int, wanted: Callable[[int], bool]) -> Walk:
        while 0 <= at < stop and at <= source.size - 4:
            head, error, body = source.get(at, 32), None, b""
            code = head[3]
            if code == 0xB9:
                yield at, code, 4, None, head[:4], b"", None
                return None
            if code == 0xBA:
                two = len(head) > 4 and head[4] >> 6 == 1
                size = 14 + (head[13] & 7 if two and len(head) > 13 else 0) if two else 12
                error, head = None if at + size <= source.size else "cut pack", head[:size]
            elif code >= 0xBB:
                size = 6 + int.from_bytes(head[4:6], "big")
                error = None if at + size <= source.size else "cut packet"
                body = source.get(at + 6, size - 6) if wanted(code) else b""
            else:
                size, head = 4, head[:4]
            yield at, code, size, None, head, body, error
            if error:
                return None
            at = source.find(cls.mark, at + size)
        return at if 0 <= at <= source.size - 4 else None

    @staticmethod
    def after(record: Record) -> int:
        return record[0] + record[2]

    @classmethod
    def resume(cls, source: Bytes, at: int) -> int | None:
        place = source.find(cls.mark, at)
        return place if 0 <= place <= source.size - 4 else None

    @staticmethod
    def guess(source: Bytes, low: int, high: int) -> int | None:
        """The first pack with the mark bits of a version."""
        at = source.find(b"\x00\x00\x01\xba", low)
        while 0 <= at < high:
            after = source.get(at + 4, 1)
            if after and (after[0] >> 6 == 1 or after[0] >> 4 == 2):
                return at
            at = source.find(b"\x00\x00\x01\xba", at + 4)
        return None

    @staticmethod
    def timed(head: bytes) -> bool:
        """Whether a packet's header has a presentation time."""
        if len(head) < 9 or head[3] < 0xBC:
            return False
        if head[6] >> 6 == 2:
            return bool(head[7] & 0x80)
        at = 6
        while at < len(head) and head[at] == 0xFF:
            at += 1
        at += 2 if at < len(head) and head[at] >> 6 == 1 else 0
        return at < len(head) and head[at] >> 4 in (2, 3)


CONTAINERS: dict[str, type[Container]] = {c.name: c for c in (Flv, ProgramStream)}
