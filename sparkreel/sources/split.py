"""Containers read by ranges of bytes, many tasks to a file.

A file is cut into ranges. A record belongs to the range that it begins in. Each
range guesses where its first record begins (a tag whose size agrees with the
size after it; a pack's start code) and walks the headers from there. Guesses are
not trusted: a range must begin where the range before it ended, or it is walked
again from there, so the result is that of one walk over the whole file, whatever
payloads look like. Ranges are rows of a table in the shared folder; a task reads
the ranges of one of its parts, and the driver holds the parts' names.

Files are opened by Arrow, at a path or a URL that all executors reach. Only
headers are read, and payloads that are wanted: `payload=False`, or a filter on
`code`, which the reader takes over, leave the others on the disk.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions import clock, headers
from ..sinks.files import scratch
from . import walk as W

RANGE = 64 << 20
#: Parts that ranges are dealt to at least, if there are so many, and at most so many that each has RANGE bytes.
_PARTS = 64
#: Bytes that are read at once where only headers are needed.
_CHUNK = 4096
_BATCH = 4096
#: Bytes of payloads after which a batch is full.
_FULL = 8 << 20

SCHEMA = "path string, seq bigint, at bigint, code bigint, size bigint, stamp bigint, head binary, payload binary, error string"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def opened(path: str) -> pa.NativeFile:
    from pyarrow.fs import FileSystem, LocalFileSystem

    files, place = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)
    return files.open_input_file(place)


class Ranged:
    """Bytes of a file; small reads are served from one chunk. bytes_read counts what came from the file."""

    def __init__(self, path: str, chunk: int = _CHUNK):
        self.file = opened(path)
        self.size, self.chunk, self.bytes_read = self.file.size(), chunk, 0
        self.start, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.held):
            data = self.file.read_at(max(n, self.chunk), at)
            self.bytes_read += len(data)
            if n > self.chunk:
                return data
            self.start, self.held = at, data
        return self.held[at - self.start : at - self.start + n]

    def find(self, marker: bytes, at: int) -> int:
        while at + len(marker) <= self.size:
            # What is held is searched before more is read.
            held = self.start + len(self.held) - at if at >= self.start else 0
            n = held if held >= len(marker) else max(self.chunk, len(marker))
            place = self.get(at, n).find(marker)
            if place >= 0:
                return at + place
            at += n - len(marker) + 1
        return -1

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


@dataclass
class Span(InputPartition):
    """A range of a file whose records begin at `start`; start -1: walk from the file's beginning."""

    path: str
    high: int
    start: int
    seq: int


def _walked(source: Ranged, container: type[W.Container], start: int, high: int, wanted: Callable[[int], bool]) -> W.Walk:
    if start < 0:
        start = yield from container.begin(source)
        if start is None:
            return None
    return (yield from container.walk(source, start, high, wanted)) if start < high else start


_INDEX = "path string, number int, low bigint, high bigint, start bigint, stop bigint, n bigint"
#: Starts and stops: there is none; the walk ended before; the file's beginning.
_NO, _OVER, _BEGIN = -3, -2, -1


def _counted(row: dict, container: type[W.Container]) -> dict:
    with Ranged(row["path"]) as source:
        start = row["start"]
        if start == _NO:
            guess = container.guess(source, row["low"], row["high"])
            start = _NO if guess is None else guess
        n, stop = 0, _NO
        if start != _NO:
            records, stop = _walked(source, container, start, row["high"], W.none), _OVER
            while True:
                try:
                    next(records)
                except StopIteration as end:
                    stop = _OVER if end.value is None else end.value
                    break
                n += 1
    return row | {"start": start, "stop": stop, "n": n}


def _index_task(kind: str):
    """Fills start (a guess, where there is none), stop and n of ranges."""
    container = W.CONTAINERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_counted(row, container) for row in batch.to_pylist()], schema=batch.schema)

    return run


def _chain_task(kind: str):
    """Walks ranges from where they start; those without a start, from where the range before them ended."""
    container = W.CONTAINERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = _NO
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                start = due if row["start"] == _NO else row["start"]
                over = start == _OVER or start >= row["high"]
                rows.append(row | {"start": start, "stop": start, "n": 0} if over else _counted(row | {"start": start}, container))
                due = rows[-1]["stop"]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _settle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of files in order, with `again`: whether one must be walked from elsewhere, as the one before ended there, or comes after such without a guess of its own. Those that need no walk are set."""
    due, chained = _NO, False
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["again"] = chained = bool(row["number"]) and chained and row["start"] == _NO
            if row["number"] and due != _NO and row["start"] != due:
                if due == _OVER or due >= row["high"]:
                    row |= {"start": due, "stop": due, "n": 0}
                else:
                    # Until it is walked, the next range's own guess stands.
                    row |= {"start": due, "stop": _NO, "n": 0, "again": True}
                    chained = True
            due = row["stop"]
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("again", pa.bool_())))


def spans(spark: SparkSession, path: str, kind: str, width: int = RANGE) -> list[str]:
    """Parts of a table of ranges of the files at a path: path, high, start and seq of those with records, where these begin and how many come before them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    count = F.greatest(F.ceil(F.col("size") / width), F.lit(1)).cast("int")
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(count), F.lit(0)).alias("ranges")).first()
    parts = max(min(total.ranges, max(_PARTS, math.ceil(total.size / RANGE))), 1)
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("number"))
    low = F.col("number").cast("bigint") * width
    todo = cut.select("path", "number", low.alias("low"), F.least(low + width, "size").alias("high"), F.when(F.col("number") == 0, _BEGIN).otherwise(_NO).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"), F.lit(None).cast("bigint").alias("n"))
    found = todo.repartition(parts, "path", "number").mapInArrow(_index_task(kind), _INDEX)
    while True:
        ordered = found.repartition("path").sortWithinPartitions("path", "number")
        settled = _stored(ordered.mapInArrow(_settle_task, f"{_INDEX}, again boolean"), "ranges")
        again = settled.where("again").drop("again")
        if again.isEmpty():
            break
        walked = again.repartition(parts, "path").sortWithinPartitions("path", "number").mapInArrow(_chain_task(kind), _INDEX)
        found = settled.where("not again").drop("again").unionByName(walked)
    before = F.sum("n").over(Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = settled.withColumn("seq", F.coalesce(before, F.lit(0)).cast("bigint")).where("n > 0")
    dealt = placed.repartitionByRange(parts, "path", "number").sortWithinPartitions("path", "number")
    return sorted(_stored(dealt.select("path", "high", "start", "seq"), "spans").inputFiles())


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Row = tuple[str, int, int, int | None, int | None, int | None, bytes, bytes | None, str | None]


def _taken(source: Ranged, container: type[W.Container], span: Span, wanted: Callable[[int], bool], codes: frozenset[int] | None, payload: bool) -> Iterator[Row]:
    for i, (at, code, size, stamp, head, body, error) in enumerate(_walked(source, container, span.start, span.high, wanted)):
        if codes is None or code in codes or (code is None and error):
            yield span.path, span.seq + i, at, code, size, stamp, head, body if payload else None, error


def batched(records: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a bounded number of rows and of bytes, but for one large payload."""
    rows, held = [], 0
    for row in records:
        rows.append(row)
        held += len(row[7] or b"")
        if len(rows) == _BATCH or held >= _FULL:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def rows_of(source: Ranged, container: type[W.Container], span: Span, wanted: Callable[[int], bool], codes: frozenset[int] | None, payload: bool) -> Iterator[pa.RecordBatch]:
    """Records of a span as Arrow batches; those of other codes are passed over."""
    yield from batched(_taken(source, container, span, wanted, codes, payload))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=NAMES)


@dataclass
class Part(InputPartition):
    """A file of the table of ranges."""

    place: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.payload = options["container"], options.get("payload", "true").lower() == "true"
        self.parts = [Part(x) for x in json.loads(options["spans"])]
        self.codes: frozenset[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("code",):
                codes = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
                self.codes = codes if self.codes is None else self.codes & codes
            # Records without a code name an error, and are left to Spark's own filter.
            yield f

    def partitions(self):
        return self.parts

    def _rows(self, part: Part) -> Iterator[Row]:
        import pyarrow.parquet as pq

        codes, payload, container = self.codes, self.payload, W.CONTAINERS[self.kind]
        with opened(part.place) as file:
            listed = [Span(**x) for x in pq.read_table(file).to_pylist()]
        for path, own in groupby(listed, lambda s: s.path):
            with Ranged(path) as source:
                for span in own:
                    yield from _taken(source, container, span, lambda code: payload and (codes is None or code in codes), codes, payload)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from batched(self._rows(partition))


class Records(DataSource):
    """Records of containers by ranges; the parts of their table come from spans()."""

    @classmethod
    def name(cls) -> str:
        return "containerrecords"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def records(spark: SparkSession, path: str, kind: str, payload: bool = True, width: int = RANGE) -> DataFrame:
    """Records of the files at a path, by ranges of `width` bytes; a task reads small ranges up to RANGE bytes together. Filters on code go to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
    listed = json.dumps(spans(spark, path, kind, width))
    return spark.read.format("containerrecords").option("container", kind).option("payload", str(payload)).option("spans", listed).load()


def _ranges_task(start: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Ranged(path, 1) as source:
                    first = start if start >= 0 else max(source.size + start, 0)
                    data = source.get(first, length)
                    yield pa.record_batch([pa.array([path]), pa.array([source.size]), pa.array([data], pa.binary()), pa.array([source.bytes_read])], names=["path", "size", "data", "bytes_read"])

    return run


def _paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path")


def ranges(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """path, size, bytes_read and `length` bytes from `start` of each file at a path; a negative start counts from the end. Nothing else is read."""
    return _paths(spark, path).mapInArrow(_ranges_task(start, length), "path string, size bigint, data binary, bytes_read bigint")


def _last_tags(source: Ranged, codes: set[int]) -> Iterator[W.Record]:
    """The last whole tag of each code, by the sizes after tags, from the file's end backwards."""
    end, left = source.size, set(codes)
    while left and end > 13:
        size = int.from_bytes(source.get(end - 4, 4), "big")
        at = end - 8 - size
        if size < 11 or at < 9:
            return
        for record in W.Flv.walk(source, at, at + 1, W.none):
            if record[1] in left and not record[6]:
                left.discard(record[1])
                yield record
        end = at + 4


def _last_packets(source: Ranged, codes: set[int], window: int) -> Iterator[W.Record]:
    """The last packet with a time of each code: the walk begins at a pack near the end, and further back until all are found."""
    while True:
        low = max(source.size - window, 0)
        start = W.ProgramStream.guess(source, low, source.size) if low else source.find(W.ProgramStream.mark, 0)
        last: dict[int, W.Record] = {}
        if start is not None and start >= 0:
            for record in W.ProgramStream.walk(source, start, source.size, W.none):
                if record[1] in codes and not record[6] and W.ProgramStream.timed(record[4]):
                    last[record[1]] = record
        if len(last) == len(codes) or not low:
            yield from last.values()
            return
        window *= 4


def _first(source: Ranged, container: type[W.Container], codes: set[int]) -> Iterator[W.Record]:
    left = set(codes)
    for record in container.whole(source, W.none):
        if record[1] in left and not record[6] and (container is W.Flv or W.ProgramStream.timed(record[4])):
            left.discard(record[1])
            yield record
        if not left:
            return


_ENDS = "path string, code bigint, place string, at bigint, stamp bigint, head binary, bytes_read bigint"


def _ends_task(kind: str, codes: set[int], window: int):
    container = W.CONTAINERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Ranged(path) as source:
                    found = [("first", r) for r in _first(source, container, codes)]
                    present = {r[1] for _, r in found}
                    # A growing file's last bytes may be no whole tag: then the sizes lead nowhere and the walk is the way.
                    tail = list(_last_tags(source, present)) if kind == "flv" else list(_last_packets(source, present, window))
                    if len(tail) < len(present):
                        tail = list({r[1]: r for r in container.whole(source, W.none) if r[1] in present and not r[6] and (kind == "flv" or W.ProgramStream.timed(r[4]))}.values())
                    rows = [(path, r[1], place, r[0], r[3], r[4], source.bytes_read) for place, r in [*found, *(("last", r) for r in tail)]]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ENDS.split(", ")])

    return run


def durations(spark: SparkSession, path: str, kind: str, codes: set[int], window: int = 1 << 16) -> DataFrame:
    """path, code, first_pts, last_pts, dur_hns, bytes_read: times of the first and last records of streams, read from a file's two ends.

    The last ones are looked for from the end backwards. What is read does not
    grow with a file whose streams all have a time near both ends. A code that a
    file does not have gives no row, and makes it read whole.
    """
    found = _paths(spark, path).repartition("path").mapInArrow(_ends_task(kind, codes, window), _ENDS)
    if kind == "flv":
        late = F.when(F.col("code") == 9, headers.flv_video(F.substring("head", 12, W.LEAD))["composition_ms"])
        pts = clock.from_ms(F.col("stamp"), F.coalesce(late, F.lit(0)))
    else:
        ticks = F.when(F.conv(F.hex(F.substring("head", 7, 1)), 16, 10).cast("int") >= 128, headers.pes_header(F.col("head"))["pts"]).otherwise(headers.packet1_header(F.col("head"))["pts"])
        pts = clock.from_90k(ticks)
    ends = found.withColumn("pts", pts).groupBy("path", "code").agg(*[F.max(F.when(F.col("place") == p, F.col("pts"))).alias(f"{p}_pts") for p in ("first", "last")], F.max("bytes_read").alias("bytes_read"))
    return ends.select("path", "code", "first_pts", "last_pts", (F.col("last_pts") - F.col("first_pts")).alias("dur_hns"), "bytes_read")
