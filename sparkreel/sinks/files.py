"""A sink that writes each row of (name, content) to a file of its own."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _place(folder: str):
    """(file system, path) of a local folder or of a URL that Arrow knows, such as file, hdfs or s3."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write under a pending folder; the commit moves what successful tasks wrote, so a repeated task leaves nothing twice."""

    def __init__(self, folder: str):
        self.folder = folder
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        files, base = _place(self.folder)
        own = posixpath.join(base, self.pending, uuid.uuid4().hex)
        files.create_dir(own, recursive=True)
        names = []
        for row in rows:
            if posixpath.basename(row["name"]) != row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            names.append(posixpath.join(own, row["name"]))
            with files.open_output_stream(names[-1]) as f:
                f.write(bytes(row["content"] or b""))
        return Written(names)

    def commit(self, messages) -> None:
        files, base = _place(self.folder)
        for message in messages:
            for path in message.names if message else []:
                files.move(path, posixpath.join(base, posixpath.basename(path)))
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        files, base = _place(self.folder)
        pending = posixpath.join(base, self.pending)
        if files.get_file_info(pending).type == FileType.Directory:
            files.delete_dir(pending)


class NamedFiles(DataSource):
    """df.write.format("namedfiles").mode("append").save(folder); the folder is local to all executors, or a URL of a store that Arrow writes to."""

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and tasks run in this process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors and the driver share")
        base = tempfile.mkdtemp(prefix=f"{spark.sparkContext.applicationId}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
