"""Phrases of two and three words that occur together more often than their parts let expect.

1. Words are counted per language. The frequent ones become a dictionary, sorted
   by hash in shards; a word's id is its rank there.
2. Two-word phrases: tasks encode their texts by the dictionary, pieces break at
   all other words, ids are packed into fixed-width binary keys and combined in
   the task. Keys are dealt to ranges, sorted there and run-length counted.
3. Three-word phrases the same way, of frequent two-word phrases only.
4. Each candidate gets its parts' counts and its lowest-scoring cut; those that
   mostly occur inside a longer one are dropped; the best of each language stay.

The ranges follow from the words' counts: a word that heads a third of all
phrases gets a third of the ranges, split by the words after it. A phrase is a
row for each task that has it, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, stored, text_column
from .shards import Shards, Tally, opened, run_lengths, written

LEAST = 10
TOP = 2000
#: Percentage of a phrase's occurrences that lie inside one longer phrase from which on it is dropped.
INSIDE = 50
#: Word occurrences for each range of keys, and dictionary entries for each shard.
RANGE_WORDS = 2_000_000
SHARD_ROWS = 2_000_000
SLICE = 1 << 20
#: Inside a task two numbers, of words or of a pair and a word, are one int64.
ID_BITS = 31
_ID = (1 << ID_BITS) - 1


def _bytes(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_BREAKS = _bytes(*b".,;:!?", *range(10, 14))
_SPACE = _BREAKS | _bytes(9, 32)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[K.Words, np.ndarray, np.ndarray]]:
    """(words, their hashes with the language's, whether the next word continues the piece) by slice."""
    langs = batch.column("lang_hash").to_numpy().view(np.uint64)
    for w in K.words(batch.column("text"), lower=True, limit=SLICE, space=_SPACE):
        counts = np.diff(w.first)
        hashes = K.mix(w.hashes ^ np.repeat(K.mix(langs[w.rows.start : w.rows.stop]), counts))
        rows = np.repeat(np.arange(len(counts)), counts)
        pieces = np.cumsum(_BREAKS[w.buf])[w.starts] if len(w.starts) else np.empty(0, np.int64)
        goes_on = np.zeros(len(hashes), bool)
        goes_on[:-1] = (rows[1:] == rows[:-1]) & (pieces[1:] == pieces[:-1])
        yield w, K.unsigned(hashes), goes_on


def _spelled(w: K.Words, which: np.ndarray) -> pa.Array:
    """The words with these numbers, A-Z lower-cased."""
    sizes = (w.ends - w.starts)[which]
    ends = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(w.starts[which] - ends[:-1], sizes) + np.arange(ends[-1])
    letters = w.buf[at]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
    return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, hashes, _ in _words(batch):
            keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            rows = np.searchsorted(w.first, first, "right") - 1 + w.rows.start
            columns = [batch.column("lang").take(pa.array(rows)), _spelled(w, first), pa.array(keys), pa.array(counts)]
            yield pa.record_batch(columns, names=["lang", "word", "key", "n"])


class Ranges:
    """Where a phrase lies between 0 and 1: the share of phrases that come before it, were words independent."""

    def __init__(self, words: Shards, before: np.ndarray, total: int):
        """before: occurrences of words in the shards before each one."""
        self.words, self.before, self.total = words, before, max(1, total)

    def _ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = np.searchsorted(self.words.ranks, ids, "right") - 1
        stop = self.before[shard] + self.words.at(ids, "upto")
        return (stop - self.words.at(ids, "n")) / self.total, stop / self.total

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Never falls from one phrase, a row of ids, to the next in order."""
        inner = np.zeros(len(ids))
        for column in ids.T[::-1]:
            start, stop = self._ends(column)
            inner = np.minimum(start + (stop - start) * inner, stop)
        return inner


def packed(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as binary keys: four bytes an id, most significant first, so keys sort as ids do."""
    return np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(len(ids), -1)


def unpacked(keys: pa.Array, width: int) -> np.ndarray:
    keys = keys.cast(pa.large_binary())
    start = int(np.frombuffer(keys.buffers()[1], np.int64)[keys.offset]) if len(keys) else 0
    return np.frombuffer(keys.buffers()[2], ">u4", len(keys) * width, start).reshape(-1, width).astype(np.int64) if len(keys) else np.empty((0, width), np.int64)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left << ID_BITS | right


def _phrase_task(ranges: Ranges, parts: int, pairs: Shards | None):
    """Partial counts (part, key, n) of two-word phrases, or of three-word phrases if pairs are given."""
    words = ranges.words

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            pair = some if pairs is None else pairs.at(some >> ID_BITS, "key")
            ids = np.stack([pair >> ID_BITS, pair & _ID] + ([] if pairs is None else [some & _ID]), axis=1)
            binary = packed(ids)
            ends = (np.arange(len(ids) + 1) * binary.shape[1]).astype(np.int32)
            part = np.minimum((ranges.place(ids) * parts).astype(np.int32), parts - 1)
            key = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(binary)])
            yield pa.record_batch([pa.array(part), key, pa.array(counts[at : at + 50_000])], names=["part", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1_000_000)
        for batch in batches:
            for _, hashes, goes_on in _words(batch):
                keys, back = np.unique(hashes, return_inverse=True)
                ids = words.rank(keys)[back]
                two = np.flatnonzero(goes_on & (ids >= 0) & (np.r_[ids[1:], -1] >= 0))
                found = _pair(ids[two], ids[two + 1]) if len(two) else np.empty(0, np.int64)
                if pairs is not None:
                    different, back = np.unique(found, return_inverse=True)
                    number = pairs.rank(different)[back]
                    three = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (two[1:] == two[:-1] + 1))
                    found = _pair(number[three], ids[two[three] + 2])
                yield from _handed(tally.add(*_combined(found)), rows)
        yield from rows(*tally.combined())

    return run


def _combined(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(found, return_counts=True)
    return keys, counts.astype(np.int64)


def _handed(full: Iterator, rows: Callable) -> Iterator[pa.RecordBatch]:
    for keys, counts in full:
        yield from rows(keys, counts)


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = unpacked(batch.column("key"), 2)
        yield pa.record_batch([pa.array(_pair(ids[:, 0], ids[:, 1])), batch.column("n")], names=["key", "n"])


def _part_task(width: int, words: Shards, pairs: Shards):
    """Candidates with their words, language and the counts of both parts of each cut; inner: the pairs inside a triple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = unpacked(batch.column("key"), width) if width == 3 else np.stack([(k := batch.column("key").to_numpy()) >> ID_BITS, k & _ID], axis=1)
            single = [words.at(c, "n") for c in ids.T]
            spelled = [words.strings(c, "word") for c in ids.T]
            inner = [_pair(a, b) for a, b in zip(ids.T[:-1], ids.T[1:], strict=True)]
            if width == 2:
                cuts = [single[0], single[1], np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)]
            else:
                cuts = [single[0], pairs.values(inner[1], "n"), pairs.values(inner[0], "n"), single[2]]
            columns = {"lang": pa.array(words.strings(ids[:, 0], "lang"), pa.string()), "phrase": pa.array([" ".join(x) for x in zip(*spelled, strict=True)], pa.string()), "a": batch.column("n")}
            columns |= {name: pa.array(c, pa.int64()) for name, c in zip(("l1", "r1", "l2", "r2"), cuts, strict=True)}
            columns |= {"inner": pa.array(np.stack(inner, axis=1).tolist(), pa.list_(pa.int64()))}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


_CANDIDATES = "lang string, phrase string, a long, l1 long, r1 long, l2 long, r2 long, inner array<long>"


def _score(left: str, right: str):
    """Exact up to counts of 10^15: the product has 38 digits at most."""
    number = "CAST({} AS DECIMAL(15,0))".format
    return F.expr(f"1000000BD * {number('a')} * {number('a')} DIV ({number(left)} * {number(right)})")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, range_words: int = RANGE_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of docs(lang, text).

    Words are runs of bytes other than blanks and tabs in pieces that end at
    .,;:!? and line breaks, A-Z lower-cased. a counts a phrase, l and r the parts
    of its lowest-scoring cut (the first of equal ones), n all words of the
    language; score is floor(10^6 * a * a / (l * r)). A phrase counts from `least`
    occurrences on. One that lies inside a longer one with `inside` percent of its
    occurrences is dropped. Ties: higher a, then the phrase's bytes. A null
    language is 'und'; null and empty texts have no words; repeated rows count
    each time; other columns are not read. A table without words gives no rows.
    Words are told apart by 64-bit hashes of language and word; the dictionary
    raises an error if two of its words share one.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), text_column().alias("text"))
    counted = docs.mapInArrow(_count_words, "lang string, word string, key long, n long")
    counts = cut(counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count_if(F.col("n") >= least).alias("frequent")).first()
    parts = sizes["words"] // range_words + 1

    words = _numbered(_ranked(counts.where(F.col("n") >= least), sizes["frequent"] // shard_rows + 1), "dictionary", ID_BITS)
    ranges = Ranges(words, *_before(docs.sparkSession, words))
    pairs = _numbered(_frequent(docs, _phrase_task(ranges, parts, None), 2, parts, least).mapInArrow(_pair_keys, "key long, n long"), "pairs", 63 - ID_BITS)
    triples, _ = stored(_frequent(docs, _phrase_task(ranges, parts, pairs), 3, parts, least), "triples")
    longer = triples.mapInArrow(_part_task(3, words, pairs), _CANDIDATES)
    return _best(_scored(_listed(docs.sparkSession, pairs).mapInArrow(_part_task(2, words, pairs), _CANDIDATES), longer, inside), totals, top)


def _numbered(df: DataFrame, name: str, bits: int) -> Shards:
    shards = written(df, name)
    if shards.ranks[-1] >> bits:
        raise ValueError(f"{shards.ranks[-1]} entries of {name} do not fit into {bits} bits")
    return shards


def _ranked(words: DataFrame, parts: int) -> DataFrame:
    """The dictionary in the order of its keys, in ranges; upto counts a range's occurrences so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            upto = so_far + np.cumsum(batch.column("n").to_numpy())
            so_far = int(upto[-1]) if len(upto) else so_far
            yield batch.append_column("upto", pa.array(upto, pa.int64()))

    ordered = words.select("key", "lang", "word", "n").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, lang string, word string, n long, upto long")


def _files(spark, shards: Shards) -> DataFrame:
    """One row for each file, in as many partitions."""
    return spark.createDataFrame([(i,) for i in range(len(shards.paths))], "file int").repartition(max(1, len(shards.paths)))


def _before(spark, words: Shards) -> tuple[np.ndarray, int]:
    """Occurrences before each file of the dictionary, and of all; the driver gets a line for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_numpy()
            yield pa.record_batch([pa.array(files), pa.array(words.at(words.ranks[files + 1] - 1, "upto"))], names=["file", "n"])

    found = sorted(tuple(r) for r in _files(spark, words).mapInArrow(run, "file int, n long").collect())
    sums = np.cumsum([0, *(n for _, n in found)])
    return sums[:-1], int(sums[-1])


def _listed(spark, pairs: Shards) -> DataFrame:
    """(key, n) of the shards, a file a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                table = opened(pairs.paths[file])
                for at in range(0, len(table["key"]), 10_000):
                    yield pa.record_batch([pa.array(table[c][at : at + 10_000]) for c in ("key", "n")], names=["key", "n"])

    return _files(spark, pairs).mapInArrow(run, "key long, n long")


def _frequent(docs: DataFrame, task, width: int, parts: int, least: int) -> DataFrame:
    """(key, n) of phrases with n >= least, in ranges of the key and sorted."""
    partial = docs.mapInArrow(task, "part int, key binary, n long")
    ordered = partial.repartitionById(parts, F.col("part")).sortWithinPartitions("key").select("key", "n")
    return ordered.mapInArrow(run_lengths(4 * width, least), "key binary, n long")


def _scored(shorter: DataFrame, longer: DataFrame, inside: int) -> DataFrame:
    """Candidates with l, r and score of their lowest cut, without those inside longer ones."""
    over = longer.select(F.explode("inner").alias("pair"), F.col("a").alias("most")).groupBy("pair").agg(F.max("most").alias("most"))
    alone = shorter.withColumn("pair", F.get("inner", F.lit(0))).join(over, "pair", "left").where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True)))
    first = F.struct(_score("l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
    second = F.struct(_score("l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r"))
    columns = ["lang", "phrase", "a"]
    return alone.select(*columns, first.alias("cut")).unionByName(longer.select(*columns, F.least(first, second).alias("cut")))


def _best(scored: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
