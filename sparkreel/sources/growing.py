"""Files that grow, as a stream of their records.

An offset is, for each file, where its next record begins and how many there
were. A batch takes whole records only: what is cut at the end of a file waits
until the rest is there. Files are read side by side. Payloads are read by the
tasks, a few hundred records at a time; the driver walks headers.

A run that goes on from its checkpoint gives each record once. Spark asks a run
how far files are before it tells where the run begins, so headers are then
walked once from the beginning, and a run's first batch takes all that is there.
Later batches take `maxbytes` of a file, or the one record that passes that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from . import split
from . import walk as W


def _files(path: str) -> list[str]:
    """The file at a path, or those in a folder, as Arrow names them."""
    from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem

    def hidden(below: str) -> bool:
        return any(part.startswith((".", "_")) for part in below.split("/"))

    remote = "://" in path
    files, place = FileSystem.from_uri(path) if remote or path.startswith("file:") else (LocalFileSystem(), path)
    info = files.get_file_info(place)
    found = [info] if info.type == FileType.File else files.get_file_info(FileSelector(place, recursive=True)) if info.type == FileType.Directory else []
    scheme = path.split("://")[0] + "://" if remote and not isinstance(files, LocalFileSystem) else ""
    return sorted(scheme + f.path for f in found if f.type == FileType.File and not hidden(f.path[len(place) :]))


def advanced(source: W.Bytes, container: type[W.Container], at: int, seq: int, most: int | None) -> tuple[int, int, bool]:
    """(place, records, over) after the whole records from a place on, of `most` bytes or the one that passes it. -1: the file's beginning."""
    first = at
    if at < 0:
        records = container.begin(source)
        try:
            next(records)
        except StopIteration as end:
            start = end.value
            if start is None:
                return at, seq, False
        else:
            # Fewer bytes than a header are no error as long as more may come.
            return (at, seq, False) if source.size < 9 else (0, seq + 1, True)
        first = at = start
    start = container.resume(source, at)
    for record in container.walk(source, start, source.size, W.none) if start is not None else ():
        if record[6]:
            if record[6].startswith("cut"):
                break
            return record[0] + 1, seq + 1, True
        at, seq = container.after(record), seq + 1
        if container is W.ProgramStream and record[1] == 0xB9:
            return at, seq, True
        if most is not None and at - first >= most:
            break
    return at, seq, False


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["container"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options["maxbytes"]) if "maxbytes" in options else None
        self.known: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        most, known = (self.most, self.known) if self.known is not None else (None, {})
        ends = dict(known)
        for path in _files(self.path):
            old = known.get(path, {"at": -1, "seq": 0, "over": False})
            if not old["over"]:
                with split.Ranged(path) as source:
                    at, seq, over = advanced(source, W.CONTAINERS[self.kind], old["at"], old["seq"], most)
                if seq > old["seq"]:
                    ends[path] = {"at": at, "seq": seq, "over": over}
        self.known = ends
        return {"files": ends}

    def partitions(self, start: dict, end: dict) -> list[split.Span]:
        before, after = start.get("files", {}), end.get("files", {})
        spans = []
        for path, stop in after.items():
            old = before.get(path, {"at": -1, "seq": 0})
            if stop["seq"] > old["seq"]:
                spans.append(split.Span(path, max(stop["at"], 1), old["at"], old["seq"]))
        return spans

    def read(self, partition: split.Span) -> Iterator[pa.RecordBatch]:
        container, payload = W.CONTAINERS[self.kind], self.payload
        with split.Ranged(partition.path) as source:
            start = partition.start if partition.start < 0 else container.resume(source, partition.start)
            span = split.Span(partition.path, partition.high, start, partition.seq)
            yield from split.rows_of(source, container, span, lambda code: payload, None, payload)

    def commit(self, end: dict) -> None:
        pass


class Growing(DataSource):
    """Options path, container (flv or mpegps), payload, maxbytes."""

    @classmethod
    def name(cls) -> str:
        return "growingcontainer"

    def schema(self) -> str:
        return split.SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def records(spark: SparkSession, path: str, kind: str, payload: bool = True, max_bytes: int | None = None) -> DataFrame:
    """A stream of the records of a file, or of the files in a folder, with the columns of split.records.

    Files and folders whose names begin with a point or an underscore are left out. A file that stops
    at an error gives that record once and no more.
    """
    spark.dataSource.register(Growing)
    reader = spark.readStream.format("growingcontainer").option("container", kind).option("payload", str(payload))
    return (reader if max_bytes is None else reader.option("maxbytes", str(max_bytes))).load(path)
