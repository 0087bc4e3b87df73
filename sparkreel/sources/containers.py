"""Containers as rows: FLV tags, program-stream packets, audio frames, WAV files.

FLV and program-stream files are read by ranges (`split`), many tasks to a file;
audio frames and WAV files come from `binaryFile`, as do contents that a table
has, where one task walks one content; files that are `Built` of rows are walked
where they are joined. Header fields are read by expressions over the records'
first bytes. `payload=False` leaves payloads where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, headers
from ..functions import tables as T
from ..operators import framing, timeline
from . import split, walk
from .walk import Record

def after_sei(data: bytes) -> bytes:
    """An AVC payload of length-prefixed units without supplemental information units at its start."""
    at = 0
    while at + 5 <= len(data) and data[at + 4] & 0x1F == 6:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return data[min(at, len(data)) :]


def flv_tags(data: bytes, wanted: Callable[[int], bool] = walk.every) -> Iterator[Record]:
    """(at, type, size, ms, head and lead, payload, error) of each tag after the file header; a record with an error is the last."""
    return walk.Flv.whole(walk.Held(data), wanted)


def program_packets(data: bytes, wanted: Callable[[int], bool] = walk.every) -> Iterator[Record]:
    """(at, code, size, None, head, payload, error) of each pack, system header and packet. Payload starts after the packet's length."""
    return walk.ProgramStream.whole(walk.Held(data), wanted)


def mpa_length(head: bytes) -> int | None:
    """Bytes of the MPEG audio frame with this header; None if it is none or of free format."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, code, padding = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if layer == 4 or index in (0, 15) or code == 3 or version == 1:
        return None
    low = version != 3
    kbps, rate = T.BIT_RATES[2 if low else 1, layer][index], T.SAMPLE_RATES[code] // {3: 1, 2: 2, 0: 4}[version]
    return (kbps * 12000 // rate + padding) * 4 if layer == 1 else kbps * 144000 // (rate << (low and layer == 3)) + padding


def ac3_length(head: bytes) -> int | None:
    """Bytes of the AC-3 frame with this sync information; None if it is none."""
    if len(head) < 6 or head[:2] != b"\x0b\x77" or head[5] >> 3 >= 12 or head[4] & 63 >= 38 or head[4] >> 6 == 3:
        return None
    kbps, odd = T.AC3_RATES[(head[4] & 63) >> 1], head[4] & 1
    return (4 * kbps, 2 * (320 * kbps // 147 + odd), 6 * kbps)[head[4] >> 6]


@dataclass(frozen=True)
class Frames:
    """A kind of audio frames: sync bytes, the rule that tells a frame's length by its head, the bytes that it needs, and the places of the two that it goes by."""

    sync: bytes
    length: Callable[[bytes], int | None]
    need: int
    places: tuple[int, int]


MPA = Frames(b"\xff", mpa_length, 4, (1, 2))
AC3 = Frames(b"\x0b\x77", ac3_length, 6, (4, 5))
#: Bytes that are searched for frames at once.
_WINDOW = 8 << 20


@cache
def _lengths(kind: Frames) -> np.ndarray:
    """Lengths of frames by the two bytes that tell them, 0 where none starts."""
    head, out = bytearray(kind.sync.ljust(kind.need, b"\0")), np.zeros((256, 256), np.int64)
    for a, b in np.ndindex(256, 256):
        head[kind.places[0]], head[kind.places[1]] = a, b
        out[a, b] = kind.length(bytes(head)) or 0
    return out


def _heads(kind: Frames, data: np.ndarray, bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where heads start from low to high, the contents that they lie in, and their frames' lengths."""
    at = low + np.flatnonzero(data[low:high] == kind.sync[0])
    own = np.searchsorted(bounds, at, "right") - 1
    whole = at + kind.need <= bounds[own + 1]
    at, own = at[whole], own[whole]
    for i, byte in enumerate(kind.sync[1:], 1):
        same = data[at + i] == byte
        at, own = at[same], own[same]
    size = _lengths(kind)[data[at + kind.places[0]], data[at + kind.places[1]]]
    return at[size > 0], own[size > 0], size[size > 0]


def _cut_out(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """n bytes from each place, as one array."""
    offsets = np.concatenate([[0], np.cumsum(n)])
    taken = data[np.repeat(at - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])


def _frame_task(kind: Frames, payload: bool):
    """Whole frames of contents; bytes that start none are passed over, and a cut frame is a content's last.

    The contents of a batch lie one after the other and are searched together: heads
    are found by numpy, and a frame leads to the first head behind its end, which
    may be the next content's.
    """

    def found(paths: pa.Array, contents: pa.Array) -> Iterator[pa.RecordBatch]:
        bounds = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset : contents.offset + len(contents) + 1]
        data = np.frombuffer(contents.buffers()[2] or b"", np.uint8)
        low, last, before = int(bounds[0]), -1, 0
        while low < bounds[-1]:
            high = min(low + _WINDOW, int(bounds[-1]))
            at, own, size = _heads(kind, data, bounds, low, high)
            ends, low = np.minimum(at + size, bounds[own + 1]), high
            follow, taken, i = np.searchsorted(at, ends).tolist(), [], 0
            while i < len(follow):
                taken.append(i)
                i = follow[i]
            if not taken:
                continue
            at, own, size, ends = at[taken], own[taken], size[taken], ends[taken]
            seq = np.arange(len(own)) - np.searchsorted(own, own)
            # A content that goes on from the last window is numbered on.
            seq[own == last] += before
            low, last, before = max(high, int(ends[-1])), own[-1], seq[-1] + 1
            body = pa.array([data[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()) if payload else pa.nulls(len(at), pa.binary())
            none, head = pa.nulls(len(at), pa.int64()), _cut_out(data, at, np.minimum(8, bounds[own + 1] - at))
            error = pc.if_else(pa.array(at + size > ends), "cut frame", pa.scalar(None, pa.string()))
            yield pa.record_batch([paths.take(pa.array(own)), pa.array(seq), pa.array(at - bounds[own]), none, pa.array(size), none, head, body, error], names=split.NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from found(batch.column("path"), pc.fill_null(batch.column("content"), b"").cast(pa.large_binary()))

    return run


def _walk_task(records: Callable[[bytes], Iterator[Record]], payload: bool):
    """Records of contents; those of many small contents come in one batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[split.Row]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for seq, (at, code, size, stamp, head, body, error) in enumerate(records(content.as_py() or b"")):
                    yield name, seq, at, code, size, stamp, head, body if payload else None, error

    return lambda batches: split.batched(found(batches))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


@dataclass(frozen=True)
class Built:
    """Files whose bytes rows hold: one for each value of a key, its rows' values in order after the bytes that every file begins with."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    value: Column
    begin: bytes = b""
    tasks: int | None = None

    def contents(self) -> DataFrame:
        """path, content"""
        joined = framing.joined_runs(self.rows, [self.key], list(self.order), self.value, self.tasks)
        return joined.select(F.col(self.key).cast("string").alias("path"), F.concat(F.lit(self.begin), "joined").alias("content"))

    def walked(self, task: Callable) -> DataFrame:
        """Rows of a task over path and content, run where files are joined: their bytes are sent to Python once and not back."""
        key, begin, join = self.key, self.begin, framing.join_task([self.key])

        def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in join(batches):
                content = batch.column("joined")
                if begin:
                    content = pc.binary_join_element_wise(pa.scalar(begin, pa.binary()), content, pa.scalar(b"", pa.binary()))
                yield pa.record_batch([batch.column(key).cast(pa.string()), content], names=["path", "content"])

        runs = framing.sorted_runs(self.rows, [key], list(self.order), self.value, self.tasks)
        return runs.mapInArrow(lambda batches: task(files(batches)), split.SCHEMA)


def _records(files: DataFrame | Built, task: Callable) -> DataFrame:
    return files.walked(task) if isinstance(files, Built) else files.select("path", "content").mapInArrow(task, split.SCHEMA)


def _skipping(tags: Callable, payload: bool) -> Callable:
    return tags if payload else partial(tags, wanted=walk.none)


def flv(spark: SparkSession, path: str, payload: bool = True, width: int = split.RANGE) -> DataFrame:
    """flv_rows of the files at a path, read by ranges of `width` bytes. A filter on code leaves other tags' payloads unread."""
    return _flv(split.records(spark, path, "flv", payload, width))


def flv_rows(files: DataFrame | Built, payload: bool = True) -> DataFrame:
    """One row for each tag of files(path, content): stream, time, size, key flag, header fields of audio and video, payload.

    The composition time of a video tag is part of its time; durations are those
    of each stream.
    """
    return _flv(_records(files, _walk_task(_skipping(flv_tags, payload), payload)))


def _flv(tags: DataFrame) -> DataFrame:
    kind, lead = T.named({8: "audio", 9: "video", 18: "script"}, F.col("code")), F.substring("head", 12, walk.LEAD)
    video, audio = F.when(F.col("code") == 9, headers.flv_video(lead)), F.when(F.col("code") == 8, headers.flv_audio(lead))
    rows = tags.select("path", "seq", "at", "code", kind.alias("stream_id"), "size", F.col("stamp").alias("ms"), video.alias("video"), audio.alias("audio"), "payload", "error")
    rows = rows.withColumn("pts_hns", clock.from_ms(F.col("ms"), F.coalesce("video.composition_ms", F.lit(0))))
    return timeline.lag_duration(rows, ["path", "stream_id"], "seq", "pts_hns")


def _unit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [None if p is None else after_sei(p[5:]) for p in batch.column("payload").to_pylist()]
        yield batch.drop_columns(["payload"]).append_column("units", pa.array(units, pa.binary()))


def avc_units(rows: DataFrame) -> DataFrame:
    """path, seq, pts_hns, key, units of flv(): what AVC video tags hold behind their five header bytes and the supplemental units at their start.

    Tags of other codecs, configurations and ends of sequences are left out; a payload that was not read gives null.
    """
    pictures = rows.where("video.codec = 7 and video.avc_type = 1").select("path", "seq", "pts_hns", F.col("video.key").alias("key"), "payload")
    return pictures.mapInArrow(_unit_task, "path string, seq bigint, pts_hns bigint, key boolean, units binary")


def mpegps(spark: SparkSession, path: str, payload: bool = True, width: int = split.RANGE) -> DataFrame:
    """mpegps_rows of the files at a path, read by ranges of `width` bytes. A filter on code leaves other packets' payloads unread."""
    return _mpegps(split.records(spark, path, "mpegps", payload, width))


def mpegps_rows(files: DataFrame | Built, payload: bool = True) -> DataFrame:
    """One row for each pack, system header and packet with its fields, of files(path, content)."""
    return _mpegps(_records(files, _walk_task(_skipping(program_packets, payload), payload)))


def _mpegps(rows: DataFrame) -> DataFrame:
    kind = headers.stream_class(F.col("code"))
    return rows.select(
        "path", "seq", "at", "code", "size", kind["kind"].alias("kind"), kind["number"].alias("number"),
        F.when(F.col("code") == 0xBA, headers.pack_header(F.col("head"))).alias("pack"), F.when(F.col("code") == 0xBB, headers.system_header(F.col("head"))).alias("system"),
        F.when(kind["kind"].isin("audio", "video", "private1"), headers.pes_header(F.col("head"))).alias("packet"), "payload", "error",
    )


def mpa(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """mpa_rows of the files at a path."""
    return mpa_rows(_files(spark, path), payload)


def mpa_rows(files: DataFrame | Built, payload: bool = True) -> DataFrame:
    """One row for each MPEG audio frame with its header, of files(path, content)."""
    return _records(files, _frame_task(MPA, payload)).select("path", "seq", "at", "size", headers.mpa_header(F.col("head")).alias("header"), "payload", "error")


def ac3(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """ac3_rows of the files at a path."""
    return ac3_rows(_files(spark, path), payload)


def ac3_rows(files: DataFrame | Built, payload: bool = True) -> DataFrame:
    """One row for each AC-3 frame with its sync information, of files(path, content)."""
    return _records(files, _frame_task(AC3, payload)).select("path", "seq", "at", "size", headers.ac3_header(F.col("head")).alias("header"), "payload", "error")


def wav(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each WAV file: header fields, bytes and duration of the data after a canonical header."""
    rows = _files(spark, path).select("path", headers.riff(F.col("content")).alias("header"), (F.octet_length("content") - 44).cast("bigint").alias("size"), (F.substring("content", 45, 2147483647) if payload else F.lit(None).cast("binary")).alias("payload"))
    return rows.withColumn("dur_hns", clock.of_bytes(F.col("size"), F.col("header.byte_rate")))


def screen_clock(spark: SparkSession, rows: int = 100, frame_hns: int = 1_000_000) -> DataFrame:
    """Times of frames that a capture at a fixed rate would emit."""
    return spark.range(rows).select(F.col("id").alias("seq"), (F.col("id") * frame_hns).alias("pts_hns"), F.lit(frame_hns).cast("bigint").alias("dur_hns"))


def screen_frames(spans: DataFrame, frame_hns: int = 1_000_000) -> DataFrame:
    """stream_id, seq, pts_hns, dur_hns of captures at a fixed rate over spans(stream_id, begin_hns, end_hns), from each begin on up to its end, which is left out. A span that is empty or lacks an end has no frames."""
    n = clock.div(F.col("end_hns") - F.col("begin_hns") + (frame_hns - 1), frame_hns)
    places = F.sequence(F.lit(0).cast("bigint"), n - 1)
    frames = spans.where("end_hns > begin_hns").select("stream_id", "begin_hns", F.explode(places).alias("seq"))
    return frames.select("stream_id", "seq", (F.col("begin_hns") + F.col("seq") * frame_hns).alias("pts_hns"), F.lit(frame_hns).cast("bigint").alias("dur_hns"))


def screen_stream(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """The same as an endless stream."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    frame = clock.SECOND // per_second
    return ticks.select(F.col("value").alias("seq"), (F.col("value") * frame).alias("pts_hns"), F.lit(frame).cast("bigint").alias("dur_hns"), "timestamp")


def ranges(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """split.ranges: size and bytes of the files at a path, of which nothing else is read."""
    return split.ranges(spark, path, start, length)


def range_rows(files: DataFrame, start: int, length: int) -> DataFrame:
    """path, size and `length` bytes from `start` of each of files(path, content); a negative start counts from the end."""
    size = F.octet_length("content").cast("bigint")
    first = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0)).cast("int")
    return files.select("path", size.alias("size"), F.substring("content", first + 1, F.lit(length)).alias("data"))


def catalog(rows: DataFrame) -> DataFrame:
    """One row for each stream of each file of flv(): rows, bytes, first and last time, duration."""
    spans = timeline.stream_span(rows.where("stream_id is not null"), ["path", "stream_id"], "seq", "pts_hns")
    sizes = rows.where("stream_id is not null").groupBy("path", "stream_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("size").alias("bytes"))
    return sizes.join(spans, ["path", "stream_id"], "left")
