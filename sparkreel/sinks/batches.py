"""Files by rows of a stream or a table, each batch committed at once.

Tasks write their rows' contents under names of their own, one to a file or, with
the option `pack`, one after the other into files of so many bytes, and a list of
them. A batch counts when its manifest is there: one file with a line for each
task, written by the driver in one go, which sees no contents' names. A batch that fails, or that a restarted stream does again, leaves no
second manifest, and what its tasks wrote is deleted. Readers go by manifests, so
they never see half a batch, and committing moves nothing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


def _place(folder: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)


#: Bytes of contents after which a batch of them is full.
_FULL = 8 << 20


@dataclass
class Written(WriterCommitMessage):
    #: The name of the task's folder and list.
    own: str


def _write(folder: str, rows: Iterator, pack: int = 0) -> Written:
    files, base = _place(folder)
    own, sink, path, at = uuid.uuid4().hex, None, "", 0
    for place in (f"parts/{own}", "index"):
        files.create_dir(posixpath.join(base, place), recursive=True)
    with files.open_output_stream(posixpath.join(base, f"index/{own}.json")) as index:
        try:
            for i, row in enumerate(rows):
                content = bytes(row["content"] or b"")
                if sink is None or at + len(content) > pack:
                    if sink:
                        sink.close()
                    path, at = f"parts/{own}/{i}", 0
                    sink = files.open_output_stream(posixpath.join(base, path))
                sink.write(content)
                index.write(f"{json.dumps({'name': row['name'], 'path': path, 'at': at, 'size': len(content)})}\n".encode())
                # A file that is not packed is over, even if it is empty.
                at += len(content) if pack else 1
        finally:
            if sink:
                sink.close()
    return Written(own)


def _commit(folder: str, batch: str, messages: list[Written | None]) -> None:
    from pyarrow.fs import FileType

    files, base = _place(folder)
    place = posixpath.join(base, "manifests", f"{batch}.json")
    if files.get_file_info(place).type == FileType.File:
        # The batch was done before; this time's files are nobody's.
        _abort(folder, messages)
        return
    files.create_dir(posixpath.dirname(place), recursive=True)
    files.create_dir(posixpath.join(base, "index"), recursive=True)
    lines = [json.dumps({"batch": batch, "own": m.own}) for m in messages if m]
    hidden = posixpath.join(base, "manifests", f".{batch}-{uuid.uuid4().hex}")
    with files.open_output_stream(hidden) as sink:
        sink.write("".join(f"{x}\n" for x in lines).encode())
    files.move(hidden, place)


def _abort(folder: str, messages: list[Written | None]) -> None:
    from pyarrow.fs import FileType

    files, base = _place(folder)
    for m in messages:
        if m and files.get_file_info(posixpath.join(base, "parts", m.own)).type == FileType.Directory:
            files.delete_dir(posixpath.join(base, "parts", m.own))
            files.delete_file(posixpath.join(base, f"index/{m.own}.json"))


class _Batch(DataSourceWriter):
    def __init__(self, folder: str, pack: int = 0):
        self.folder, self.pack, self.batch = folder, pack, f"run-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        return _write(self.folder, rows, self.pack)

    def commit(self, messages) -> None:
        _commit(self.folder, self.batch, messages)

    def abort(self, messages) -> None:
        _abort(self.folder, messages)


class _Stream(DataSourceStreamWriter):
    def __init__(self, folder: str, pack: int = 0):
        self.folder, self.pack = folder, pack

    def write(self, rows) -> Written:
        return _write(self.folder, rows, self.pack)

    def commit(self, messages, batchId: int) -> None:
        _commit(self.folder, f"{batchId:020}", messages)

    def abort(self, messages, batchId: int) -> None:
        _abort(self.folder, messages)


class FileBatches(DataSource):
    """Rows (name, content) written with format("filebatches") to a folder, or a URL of a store that Arrow writes to. Option pack: bytes of a file that contents share, else each has its own."""

    @classmethod
    def name(cls) -> str:
        return "filebatches"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Batch(self.options["path"], int(self.options.get("pack", 0)))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Stream(self.options["path"], int(self.options.get("pack", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileBatches)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """batch, name, path, at, size of every content of committed batches. Names may repeat; null names are null."""
    done = spark.read.schema("batch string, own string").json(f"{folder}/manifests")
    found = spark.read.schema("name string, path string, at bigint, size bigint").json(f"{folder}/index")
    found = found.withColumn("own", F.element_at(F.split("path", "/"), 2)).withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("path")))
    return found.join(done, "own").select("batch", "name", "path", "at", "size")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of places in files, which come file by file."""
    path, file = None, None
    try:
        for batch in batches:
            start, held, full = 0, [], 0
            for i, (place, at, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True)):
                if place != path:
                    if file:
                        file.close()
                    files, local = _place(place)
                    path, file = place, files.open_input_file(local)
                held.append(file.read_at(size, at))
                full += size
                if i + 1 == batch.num_rows or full >= _FULL:
                    yield batch.slice(start, len(held)).select(["batch", "name"]).append_column("content", pa.array(held, pa.binary()))
                    start, held, full = i + 1, [], 0
    finally:
        if file:
            file.close()


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """batch, name, content of every content of committed batches; a file is read by one task, from its beginning on."""
    places = listed(spark, folder).repartition("path").sortWithinPartitions("path", "at")
    return places.mapInArrow(_read_task, "batch string, name string, content binary")
