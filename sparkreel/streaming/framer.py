"""Frame-aligned chunks of byte streams, with the cut tail carried over to the next chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import containers

#: Keys that streams are dealt to.
KEYS = 4096

#: What a kind of stream needs: length of a frame by its head, sync bytes, bytes of a head.
KINDS: dict[str, tuple[Callable[[bytes], int | None], bytes, int]] = {"ac3": (containers.ac3_length, b"\x0b\x77", 6), "mpa": (containers.mpa_length, b"\xff", 4)}


def split(data: bytes, kind: str) -> tuple[list[bytes], bytes]:
    """(whole frames, rest to keep). Bytes that cannot start a frame are dropped."""
    length, sync, need = KINDS[kind]
    out, at = [], 0
    while True:
        at = data.find(sync, at)
        if at < 0:
            # The last bytes may be the start of a sync word.
            keep = len(sync) - 1
            return out, data[len(data) - keep :] if keep and data.endswith(sync[:keep]) else b""
        head = data[at : at + need]
        if len(head) < need:
            return out, data[at:]
        size = length(head)
        if size is None:
            at += 1
        elif at + size > len(data):
            return out, data[at:]
        else:
            out.append(data[at : at + size])
            at += size


class Framer(StatefulProcessor):
    """State of the streams that share a key: of each, the bytes after its last whole frame, and how many frames it had."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "streams array<string>, rests array<binary>, frames array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streams, rests, frames = self.rest.get() if self.rest.exists() else ((), (), ())
        held = {s: (bytes(r), n) for s, r, n in zip(streams, rests, frames, strict=True)}
        chunks = pd.concat(list(rows)).sort_values("seq")
        parts: dict[str | None, list[bytes]] = {}
        for stream, data in zip(chunks["stream_id"], chunks["data"], strict=True):
            own = parts.setdefault(None if pd.isna(stream) else stream, [])
            if data is not None:
                own.append(bytes(data))
        out: list[tuple[str | None, int, bytes]] = []
        for stream, own in parts.items():
            rest, n = held.get(stream, (b"", 0))
            found, rest = split(rest + b"".join(own), self.kind)
            held[stream] = rest, n + len(found)
            out.extend((stream, n + i, frame) for i, frame in enumerate(found))
        self.rest.update((list(held), [r for r, _ in held.values()], [n for _, n in held.values()]))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "frame_no", "data"])

    def close(self) -> None:
        pass


def framed(chunks: DataFrame, kind: str, keys: int = KEYS) -> DataFrame:
    """stream_id, frame_no, data of a stream of chunks(stream_id, seq, data), whose seq ascends from batch to batch.

    Works on streams and on tables. Needs the RocksDB state store on a stream.
    Streams are dealt to `keys` keys, whose states are read and written as one.
    """
    dealt = chunks.select(F.pmod(F.xxhash64("stream_id"), F.lit(keys)).alias("deal"), "stream_id", "seq", "data")
    return dealt.groupBy("deal").transformWithStateInPandas(Framer(kind), "stream_id string, frame_no bigint, data binary", "Append", "None")
