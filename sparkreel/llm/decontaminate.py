"""Benchmark decontamination: size-partitioned MinHash containment search.

Sets are distinct k-word shingles (A-Z lower-cased). An item leaks into a
document that holds at least `percent` of its shingles. An item of fewer than k
words is one n-gram of its own length: documents probe with n-grams of every such
length that an item has, at most k - 1 more, so it is found inside longer ones.

Items are partitioned by set size into powers of two. An item's sketch is its
m smallest shingle hashes, where m is one more than the shingles it may miss:
a document that holds enough of the item holds at least one of them, however
long it is, so the search loses nothing. A document probes with the shingles
below a partition's largest sketch value, and only partitions whose items it is
large enough to hold. Candidates are verified on the full sets.

Items up to INDEX_LIMIT shingles are broadcast; beyond that size the search is a
shuffled join on the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, text_column

INDEX_LIMIT = 2_000_000
_SLOTS = 1 << 22


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a document must hold of n: 100 * held >= percent * n."""
    return -(-percent * n // 100)


def _sets(texts: pa.Array, lengths: list[int], short: bool = False) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, n-gram hashes, cuts) of runs of rows. short: a row gets those of the largest length that it has words for alone."""
    for w in K.words(texts, lower=True):
        found = [w.grams(n) for n in lengths]
        rows = [np.searchsorted(w.first, at, "right") - 1 for _, at in found]
        if short:
            most = np.minimum(np.diff(w.first), max(lengths))
            kept = [most[r] == n for n, r in zip(lengths, rows, strict=True)]
            found, rows = [(v[x], at[x]) for (v, at), x in zip(found, kept, strict=True)], [r[x] for r, x in zip(rows, kept, strict=True)]
        values, rows = np.concatenate([v for v, _ in found]), np.concatenate(rows)
        order = np.argsort(rows, kind="stable")
        yield w.rows, values[order], np.searchsorted(rows[order], np.arange(len(w.rows) + 1))


def _item_task(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            words = np.concatenate([np.diff(w.first) for w in K.words(batch.column("text"), lower=True)]) if batch.num_rows else np.empty(0, np.int64)
            for rows, values, cuts in _sets(batch.column("text"), list(range(1, k + 1)), short=True):
                sets = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                sizes = np.array([len(x) for x in sets], np.int64)
                least = needed(sizes, percent)
                sketches = [K.unsigned(x[: len(x) - m + 1]) if len(x) else np.empty(0, np.int64) for x, m in zip(sets, least, strict=True)]
                lengths = np.minimum(words[rows.start : rows.stop], k)
                yield pa.record_batch([ids.slice(rows.start, len(rows)), pa.array(lengths, pa.int32()), pa.array(sizes), pa.array([K.unsigned(x) for x in sets], pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["item_id", "length", "n_shingles", "shingles", "sketch"])

    return run


def sketched_items(items: DataFrame, k: int, percent: int) -> DataFrame:
    """item_id, length, n_shingles, shingles, sketch; length: words of a shingle, k or for shorter items their own; items without an id or without words are no items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text")).where("item_id is not null")
    return items.mapInArrow(_item_task(k, percent), "item_id long, length int, n_shingles long, shingles array<long>, sketch array<long>").where("n_shingles > 0")


class _Index:
    """Sketches of all items: partitions by size, a hash filter, postings."""

    def __init__(self, items: pa.Table, percent: int):
        def lists(name: str) -> list[np.ndarray]:
            return [x for part in items[name].chunks for x in np.split(part.flatten().to_numpy().view(np.uint64), np.cumsum(part.value_lengths().to_numpy())[:-1])]

        items = pa.Table.from_batches([b for b in items.to_batches() if b.num_rows], items.schema)
        self.ids = items["item_id"].to_numpy()
        self.sets = lists("shingles")
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.least = needed(self.sizes, percent)
        part = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(int)
        hashes = lists("sketch")
        self.partitions = []
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            values = np.concatenate([hashes[i] for i in own])
            owner = np.repeat(own, [len(hashes[i]) for i in own])
            order = np.argsort(values, kind="stable")
            slots = np.zeros(_SLOTS, bool)
            slots[(values & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
            self.partitions.append((self.least[own].min(), values[order], owner[order], slots))

    def candidates(self, values: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a sketch value. sizes: shingles of each row, repeats included."""
        found: set[tuple[int, int]] = set()
        for least, sketch, owner, slots in self.partitions:
            hit = np.flatnonzero((values <= sketch[-1]) & slots[(values & np.uint64(_SLOTS - 1)).astype(np.int64)])
            hit = hit[sizes[rows[hit]] >= least]
            low, high = np.searchsorted(sketch, values[hit]), np.searchsorted(sketch, values[hit], "right")
            for i in np.flatnonzero(high > low):
                found.update((int(rows[hit[i]]), int(x)) for x in owner[low[i] : high[i]])
        return found


def _search_task(shared: Broadcast, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for rows, values, cuts in _sets(batch.column("text"), lengths):
                sizes = np.diff(cuts)
                pairs = index.candidates(values, np.repeat(np.arange(len(rows)), sizes), sizes)
                own = {r: np.unique(values[cuts[r] : cuts[r + 1]]) for r in {r for r, _ in pairs}}
                for r, x in sorted(pairs):
                    held = int(np.isin(index.sets[x], own[r], assume_unique=True).sum())
                    if held >= index.least[x]:
                        out.append((rows.start + r, index.ids[x], index.sizes[x], held))
            columns = [pa.array(np.array(c, np.int64)) for c in (list(zip(*out, strict=True)) or [[], [], [], []])]
            yield pa.record_batch([*(batch.column(c).take(columns[0]) for c in _ROW), *columns[1:]], names=[*_ROW, "item_id", "n_shingles", "n_shared"])

    return run


def _probe_task(lengths: list[int], largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, cuts in _sets(batch.column("text"), lengths):
                row = np.repeat(np.arange(len(rows)), np.diff(cuts))
                low = values <= np.uint64(largest)
                at = pa.array(rows.start + row[low])
                yield pa.record_batch([*(batch.column(c).take(at) for c in _ROW), pa.array(K.unsigned(values[low]))], names=[*_ROW, "hash"])

    return run


def _verify_task(lengths: list[int], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, shingles = [], batch.column("shingles")
            for rows, values, cuts in _sets(batch.column("text"), lengths):
                held += [int(np.isin(shingles[r].values.to_numpy().view(np.uint64), values[cuts[i] : cuts[i + 1]]).sum()) for i, r in enumerate(rows)]
            out = pa.record_batch([*(batch.column(c) for c in (*_ROW, "item_id", "n_shingles")), pa.array(held, pa.int64())], names=[*_ROW, "item_id", "n_shingles", "n_shared"])
            yield out.filter(pa.array(100 * np.array(held, np.int64) >= percent * batch.column("n_shingles").to_numpy()))

    return run


_ROW = ("doc_id", "row_hash")
_PAIRS = "doc_id long, row_hash long, item_id long, n_shingles long, n_shared long"


def _row_hash() -> Column:
    return F.xxhash64(text_column())


def _holding(docs: DataFrame, items: DataFrame, k: int, percent: int, index_limit: int) -> DataFrame:
    """The rows of _PAIRS: ids, which may be null, hashes of texts, and the items that they hold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("row_hash"), text_column().alias("text"))
    sketched = cut(sketched_items(items, k, percent), "items")
    size = sketched.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted({k, *size["lengths"]})  # k numbers at most
    if size["n"] <= index_limit:
        table = sketched.drop("length").toArrow()  # at most index_limit hashes
        if not table.num_rows:
            return docs.sparkSession.createDataFrame([], _PAIRS)
        index = docs.sparkSession.sparkContext.broadcast(_Index(table, percent))
        return docs.mapInArrow(_search_task(index, lengths), _PAIRS)
    # Unsigned order of the last sketch value: flip the sign bit.
    top = sketched.agg(F.max(F.element_at("sketch", -1).bitwiseXOR(F.lit(-(1 << 63)))).alias("top")).first()["top"]
    probes = docs.mapInArrow(_probe_task(lengths, (top ^ -(1 << 63)) % (1 << 64)), "doc_id long, row_hash long, hash long")
    pairs = probes.join(sketched.select("item_id", F.explode("sketch").alias("hash")), "hash").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "item_id").distinct()
    full = pairs.join(sketched.drop("sketch", "length"), "item_id").join(docs, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("row_hash")))
    return full.drop("__id", "__hash").mapInArrow(_verify_task(lengths, percent), _PAIRS)


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: one row for each item that a document holds.

    n_shingles counts the item's set, n_shared those that the document holds. An
    item of fewer than k words is held by every document that has its words one
    after the other. Rows without an id, null or empty texts take no part; items
    without an id or without words are none. Repeated rows with one id and text
    give repeated results. Other columns are not read.
    """
    held = _holding(docs.where("doc_id is not null"), items, k, percent, index_limit).drop("row_hash")
    return held.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that hold an item; a row is known by its id, which may be null, and a hash of its text."""
    hit = _holding(docs, items, k, percent, INDEX_LIMIT).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["__id"]) & (_row_hash() == hit["__hash"]), "left_anti")
