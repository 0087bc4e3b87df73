"""Sorted tables that tasks look up in place.

A DataFrame that is partitioned by ranges of a key and sorted inside them becomes
one Arrow file a partition in the shared folder. Tasks map the files into memory
and find keys by binary search, so a lookup costs no shuffle and a machine's
tasks share the pages they touch. The driver holds a line for each file, however
many keys there are. Files are written under new names, and only those of tasks
that succeeded are used, so repeated and lost tasks do no harm. Files outside a
local or mounted folder are copied to a nameless temporary file before mapping.
"""

from __future__ import annotations

import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame

from .common import shared_folder


def place(path: str) -> tuple[FileSystem, str]:
    """(file system, path) of a local folder or of a URL that Arrow knows, such as file, hdfs or s3."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


@lru_cache(maxsize=256)
def opened(path: str) -> dict[str, np.ndarray | pa.Array]:
    """Columns of a file: arrays of numbers over the mapped memory, strings as Arrow's."""
    files, where = place(path)
    if isinstance(files, LocalFileSystem):
        source = pa.memory_map(where)
    else:
        with tempfile.TemporaryFile() as copy, files.open_input_stream(where) as stream:
            shutil.copyfileobj(stream, copy)
            copy.flush()
            source = pa.memory_map(f"/dev/fd/{copy.fileno()}")
    batch = pa.ipc.open_file(source).get_batch(0)
    return {f.name: c if pa.types.is_large_string(f.type) else c.to_numpy() for f, c in zip(batch.schema, batch.columns, strict=True)}


class Shards(NamedTuple):
    """Files in ascending order of their keys; rank counts keys over all of them."""

    paths: tuple[str, ...]
    first: np.ndarray
    ranks: np.ndarray

    def _parts(self, edges: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(file, places in wanted, wanted there) by file."""
        order = np.argsort(wanted, kind="stable")
        wanted = wanted[order]
        cuts = np.r_[0, np.searchsorted(wanted, edges[1:], "left"), len(wanted)] if len(edges) else np.zeros(1, int)
        for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                yield number, order[a:b], wanted[a:b]

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key among all keys, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for number, where, part in self._parts(self.first, keys):
            stored = opened(self.paths[number])["key"]
            at = np.minimum(np.searchsorted(stored, part), len(stored) - 1)
            out[where] = np.where(stored[at] == part, self.ranks[number] + at, -1)
        return out

    def at(self, ranks: np.ndarray, column: str, missing: int = 0) -> np.ndarray:
        """Values of a column of whole numbers; missing where the rank is -1."""
        out = np.full(len(ranks), missing, np.int64)
        known = np.flatnonzero(ranks >= 0)
        for number, where, part in self._parts(self.ranks[:-1], ranks[known]):
            out[known[where]] = opened(self.paths[number])[column][part - self.ranks[number]]
        return out

    def strings(self, ranks: np.ndarray, column: str) -> list[str]:
        out = np.empty(len(ranks), object)
        for number, where, part in self._parts(self.ranks[:-1], ranks):
            out[where] = opened(self.paths[number])[column].take(pa.array(part - self.ranks[number])).to_pylist()
        return out.tolist()

    def values(self, keys: np.ndarray, column: str, missing: int = 0) -> np.ndarray:
        return self.at(self.rank(keys), column, missing)


def _write_task(folder: str, columns: list[str], unique: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b.select(columns) for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        table = table.cast(pa.schema([(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in table.schema]))
        keys = table["key"].to_numpy()
        if (keys[1:] < keys[:-1]).any() or (unique and (keys[1:] == keys[:-1]).any()):
            raise ValueError("keys of a shard must ascend, and differ unless they may repeat")
        files, where = place(folder)
        files.create_dir(where, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        with files.open_output_stream(posixpath.join(where, name)) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=len(table))
        yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([int(keys[0])]), pa.array([len(keys)])], names=["path", "first", "n"])

    return run


def written(df: DataFrame, name: str, unique: bool = True) -> Shards:
    """Shards of df(key long, ...), whose partitions are ranges of key and sorted. A task holds one partition, the driver a line for each.

    With unique, a key that repeats is an error; without, rank() gives its first place.
    """
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    made = sorted(df.mapInArrow(_write_task(folder, df.columns, unique), "path string, first long, n long").collect(), key=lambda r: r["first"])
    return Shards(tuple(r["path"] for r in made), np.array([r["first"] for r in made], np.int64), np.cumsum([0, *(r["n"] for r in made)]))


def run_lengths(width: int | None = None, least: int = 1):
    """A task over rows (key, n) sorted by key: one row for each different key with the sum of n, if that is least or more.

    Keys are int64, or binary of `width` bytes. A run may go on over batches.
    """

    def plain(column: pa.Array) -> np.ndarray:
        if width is None:
            return column.to_numpy(zero_copy_only=False)
        column = column.cast(pa.large_binary())
        start = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
        return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, start).reshape(-1, width)

    def packed(keys: np.ndarray) -> pa.Array:
        if width is None:
            return pa.array(keys)
        ends = pa.py_buffer((np.arange(len(keys) + 1) * width).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, ends, pa.py_buffer(np.ascontiguousarray(keys))])

    def rows(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        kept = sums >= least
        return pa.record_batch([packed(keys[kept]), pa.array(sums[kept])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sums = plain(batch.column("key")), batch.column("n").to_numpy()
            if last is not None:
                keys, sums = np.concatenate([last[0], keys]), np.concatenate([last[1], sums])
            moved = keys[1:] != keys[:-1]
            starts = np.flatnonzero(np.r_[True, moved if width is None else moved.any(axis=1)])
            keys, sums = keys[starts], np.add.reduceat(sums, starts)
            last = keys[-1:].copy(), sums[-1:].copy()
            yield rows(keys[:-1], sums[:-1])
        if last is not None:
            yield rows(*last)

    return run


class Tally:
    """Counts of keys, combined as they come; over `limit` different ones they are handed on."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit:
            keys, counts = self.combined()
            if len(keys) > self.limit // 2:
                yield keys, counts
            else:
                self.parts, self.size = [(keys, counts)], len(keys)

    def combined(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, back, np.concatenate([c for _, c in parts]))
        return keys, counts
