"""Stupid-backoff language-model scores, computed by joins between blocks and buckets.

Documents are dealt to blocks of about BLOCK_BYTES. A block explodes its n-grams,
combines equal ones and asks for each of them once: requests are dealt to buckets
by the n-gram's hash. A bucket is one part of the count table: it adds up the
counts of all blocks and answers every request. The answers are joined to their
block's documents, and the scores of a document's words are summed.

An n-gram crosses the network once for each block that has it, so a very
frequent one costs a row's share for each block, not for each document, and no
bucket grows with the frequency of its n-grams. Blocks and buckets grow in number
with the input. An n-gram is identified by its number of words and its 64-bit
hash, with about a million n-grams to a bucket.

S(w | h) = count(h w) / count(h) if count(h w) >= min_count, else alpha * S(w | h
without its first word); for a single word count(w) / count of all words.
Histories end at the start of a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import input_bytes, text_column

BLOCK_BYTES = 8_000_000
ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Stands for "all words" among the single words.
_TOTAL = np.uint64(0x7F4A7C15F39CC060)


def pack_counts(counts: np.ndarray) -> bytes:
    """A bit for each count says whether it is not 1; those have a byte each; from 255 on they follow as int64."""
    other = counts[counts != 1]
    return np.packbits(counts != 1).tobytes() + np.minimum(other, 255).astype(np.uint8).tobytes() + other[other >= 255].astype("<i8").tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    head = -(-n // 8)
    over = np.unpackbits(np.frombuffer(packed, np.uint8, head), count=n).astype(bool)
    many = np.frombuffer(packed, np.uint8, int(over.sum()), head).astype(np.int64)
    many[many == 255] = np.frombuffer(packed, "<i8", offset=head + len(many))
    counts = np.ones(n, np.int64)
    counts[over] = many
    return counts


def pack_keys(values: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first one, then differences as four low bytes each and Huffman-coded high bytes."""
    steps = np.diff(values)
    high = (steps >> np.uint64(32)).astype("<u4")
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    packed = coder.compress(high.view(np.uint8).reshape(-1, 4).T.tobytes()) + coder.flush()
    return values[:1].astype("<u8").tobytes() + (steps & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + packed + len(steps).to_bytes(8, "little")


def unpack_keys(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[-8:], "little")
    low = np.frombuffer(packed, "<u4", n, 8).astype(np.uint64)
    high = np.frombuffer(zlib.decompress(packed[8 + 4 * n : -8]), np.uint8).reshape(4, n).astype(np.uint64)
    steps = low | high[0] << np.uint64(32) | high[1] << np.uint64(40) | high[2] << np.uint64(48) | high[3] << np.uint64(56)
    return np.cumsum(np.r_[np.frombuffer(packed, "<u8", 1), steps])


_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _pack_task(blocks: int):
    """Rows of one block and batch together, compressed.

    A row's block follows from its hash and its number among the equal rows of its
    partition: the same blocks whatever the order of the rows, and equal rows do not
    meet in one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            unique, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            by = np.argsort(back, kind="stable")
            number = np.empty(len(hashes), np.uint64)
            number[by] = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            number += np.array([seen.get(h, 0) for h in unique.tolist()], np.uint64)[back]
            for h, n in zip(unique.tolist(), counts.tolist(), strict=True):
                seen[h] = seen.get(h, 0) + n
            block = ((K.mix(hashes + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            out: dict[str, list] = {"block": [], "docs": []}
            for a, b in _runs(block[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(pa.Table.from_batches([batch.select(["doc_id", "text"])]).take(pa.array(order[a:b])).cast(_DOCS))
                out["block"].append(int(block[order[a]]))
                out["docs"].append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(out["block"], pa.int32()), pa.array(out["docs"], pa.binary())], names=["block", "docs"])

    return run


def _docs(group: pa.Table) -> pa.Table:
    parts = [pa.ipc.open_stream(x.as_py()).read_all() for x in group["docs"]]
    return pa.concat_tables(parts) if parts else _DOCS.empty_table()


class _Block:
    """A block's words; for each order, one after the other, its different n-grams in the order of their requests."""

    def __init__(self, texts: pa.ChunkedArray):
        parts = [(np.diff(w.first), w.hashes) for w in K.words(texts)]
        self.sizes = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.int64)
        self.hashes = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.uint64)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(self.hashes)) - np.repeat(first, self.sizes)).astype(np.int32)

    def orders(self, order: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, words at which an n-gram ends, its number, keys, counts, buckets, request order); single words end with the total."""
        grams = self.hashes
        for n in range(1, order + 1):
            if n > 1:
                # The n-gram that ends at word i: the shorter one that ends at i, and the word before it.
                earlier = np.r_[np.zeros(n - 1, np.uint64), self.hashes][: len(self.hashes)]
                grams = K.mix(grams * np.uint64(0xFF51AFD7ED558CCD) + earlier + np.uint64(n))
            has = np.flatnonzero(self.place >= n - 1).astype(np.int32)
            unique, back, counts = np.unique(grams[has], return_inverse=True, return_counts=True)
            back = back.astype(np.int32)
            if n == 1:
                unique, counts = np.r_[unique, _TOTAL], np.r_[counts, len(self.hashes)]
            # A bijection, so keys are whole hashes. Buckets are ranges of keys, which keeps a bucket's keys close.
            keys = K.mix(unique ^ np.uint64(0xA0761D6478BD642F))
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(keys).astype(np.int32)
            yield n, has, back, keys, counts, bucket[by], by


def _request_task(order: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        number = group["block"][0].as_py()
        out: dict[str, list] = {x: [] for x in ("bucket", "block", "n", "keys", "counts")}
        for n, _, _, keys, counts, bucket, by in _Block(_docs(group)["text"]).orders(order, buckets):
            for a, b in _runs(bucket):
                out["bucket"].append(int(bucket[a]))
                out["block"].append(number)
                out["n"].append(n)
                out["keys"].append(pack_keys(keys[by[a:b]]))
                out["counts"].append(pack_counts(counts[by[a:b]]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True) if len(starts) else iter(())


def _count_task(group: pa.Table) -> pa.Table:
    number, orders, blocks = group["bucket"][0].as_py(), group["n"].to_numpy(), group["block"].to_numpy()
    out: dict[str, list] = {x: [] for x in ("block", "n", "bucket", "counts")}
    for n in np.unique(orders):
        rows = np.flatnonzero(orders == n)
        keys = [unpack_keys(group["keys"][int(r)].as_py()) for r in rows]
        sizes = [len(x) for x in keys]
        counts = np.concatenate([unpack_counts(group["counts"][int(r)].as_py(), s) for r, s in zip(rows, sizes, strict=True)])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(back.max() + 1, np.int64)
        np.add.at(sums, back, counts)
        for r, part in zip(rows, np.split(sums[back], np.cumsum(sizes)[:-1]), strict=True):
            out["block"].append(int(blocks[r]))
            out["n"].append(int(n))
            out["bucket"].append(number)
            out["counts"].append(pack_counts(part))
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("n", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())]))


def _score_task(order: int, buckets: int, alpha: float, min_count: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(docs)
        block = _Block(docs["text"])
        at = {(n, b): i for i, (n, b) in enumerate(zip(answers["n"].to_pylist(), answers["bucket"].to_pylist(), strict=True))}
        words = len(block.place)
        found, total = [], 1
        for n, has, back, keys, _, bucket, by in block.orders(order, buckets):
            sums = np.zeros(len(keys), np.int64)
            for a, b in _runs(bucket):
                sums[by[a:b]] = unpack_counts(answers["counts"][at[n, int(bucket[a])]].as_py(), b - a)
            if n == 1:
                total = sums[-1]
            counts = np.zeros(words, np.int64)
            counts[has] = sums[back]
            found.append(counts)
        value = np.log(found[0] / total) if words else np.empty(0)
        used = np.ones(words, np.int64)
        for n in range(2, order + 1):
            long_enough = block.place >= n - 1
            value = np.where(long_enough, value + np.log(alpha), value)
            seen = np.flatnonzero(long_enough & (found[n - 1] >= min_count))
            value[seen] = np.log(found[n - 1][seen] / found[n - 2][seen - 1])
            used[seen] = n
        micros = np.rint(value * 1e6).astype(np.int64)
        edges = np.r_[0, np.cumsum(block.sizes)]
        add = lambda x: np.diff(np.r_[0, np.cumsum(x)][edges])
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(block.sizes, pa.int64()), "n_full": pa.array(add((used == order).astype(np.int64)), pa.int64()), "score_micros": pa.array(add(micros), pa.int64())})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_full, score_micros for every row of docs(doc_id, text).

    score_micros sums round(1e6 * ln S) over the words, n_full counts those scored
    without backing off. Words are runs of bytes other than space and \\t \\n \\v \\f
    \\r, unchanged. All rows count, repeated ones too. Null or empty text: no
    words, sum 0. Ids may be null or repeated. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    blocks = max(1, -(-input_bytes(docs) // block_bytes))
    dealt = docs.withColumn("hash", F.xxhash64("doc_id", "text")).mapInArrow(_pack_task(blocks), "block int, docs binary")
    requests = dealt.groupBy("block").applyInArrow(_request_task(order, blocks), "bucket int, block int, n int, keys binary, counts binary")
    answers = requests.groupBy("bucket").applyInArrow(_count_task, "block int, n int, bucket int, counts binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    return scored.applyInArrow(_score_task(order, blocks, alpha, min_count), "doc_id long, n_words long, n_full long, score_micros long")
