"""Substring dedup on a compacted de Bruijn graph of token k-mers.

Edges are the windows of `window` consecutive words. Consecutive edges of a
document with the same smallest seed (a hash of SEED words) form a segment: where
it starts and ends depends on the words alone, so repeats of a passage in other
documents give the same segments.

1. Each document's edges become segments (seed, print of its words, place, print
   of the segment that follows).
2. A segment has out-degree one if the same segment follows at all its places. If
   that one has no more places, its in-degree is one too, and both belong to one
   nonbranching path. Paths of repeated segments compact to their first segment,
   which keeps the first document's coordinates and the length.
3. A join of all segments with the paths' first ones gives repeats of whole paths.
4. Seeds with several prints branch. Only there, one place of each segment is
   opened into single edges, joined on (seed, edge). What repeats there repeats
   at every place of the segment in documents with that id.
5. At the source's coordinates a digest of the words is taken. Where a document's
   spans are cut, the words there have to give the same digest, else the span
   does not count.

Only segments cross the network: about two rows for every (window - SEED + 2)
words. Rows are told apart by id and a hash of the text, so that ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import discard, stored, text_column

SEED = 20
DIGEST_BYTES = 16


def segments(w: K.Words, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, seed, print, first word, edges, next print) of each row's segments; places count from the row's start, the last one's next is 0."""
    n = len(w.hashes)
    empty = np.empty(0, np.int64)
    if n < window:
        return (empty,) * 6
    at = np.arange(n - seed + 1)
    lows = K.sliding_min(K._ranges(w.hashes, at, at + seed, K._WORD_BASE), window - seed + 1)
    sizes = np.diff(w.first)
    rows = np.repeat(np.arange(len(w.rows)), sizes)[: len(lows)]
    edge = np.flatnonzero(np.arange(len(lows)) + window <= w.first[1:][rows])
    if not len(edge):
        return (empty,) * 6
    value, row = lows[edge], rows[edge]
    head = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    start = np.flatnonzero(head)
    count = np.diff(np.r_[start, len(edge)])
    begin = edge[start]
    end = begin + count + window - 1
    prints = K.unsigned(K.mix(K._ranges(w.hashes, begin, end, K._WORD_BASE + 2) + count.astype(np.uint64)))
    row = row[start]
    following = np.r_[np.where(row[1:] == row[:-1], prints[1:], 0), 0]
    return row, K.unsigned(value[start]), prints, begin - w.first[row], count, following


_SEGMENTS = "seed long, print long, doc_id long, row long, at int, edges int, next long"


def _segment_task(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = (batch.column(x).to_numpy() for x in ("doc_id", "row"))
            for w in K.words(batch.column("text")):
                row, low, own, at, count, following = segments(w, window, seed)
                columns = [low, own, ids[w.rows.start + row], prints[w.rows.start + row], at.astype(np.int32), count.astype(np.int32), following]
                yield pa.record_batch([pa.array(c) for c in columns], names=["seed", "print", "doc_id", "row", "at", "edges", "next"])

    return run


class _Plain:
    """Words of a slice joined by single spaces, to take digests of runs of words."""

    def __init__(self, w: K.Words):
        sizes = w.ends - w.starts + 1
        stops = np.cumsum(sizes)
        begin = stops - sizes
        take = np.arange(stops[-1] if len(stops) else 0) - np.repeat(begin - w.starts, sizes)
        text = np.append(w.buf, np.uint8(32))[take]
        text[stops - 1] = 32
        self.text, self.begin, self.stops = text.tobytes(), begin.tolist(), stops.tolist()

    def digest(self, start: int, stop: int) -> bytes:
        return blake2b(self.text[self.begin[start] : self.stops[stop - 1] - 1], digest_size=DIGEST_BYTES).digest()


_OPENED = "seed long, edge long, doc_id long, row long, source_at int, begin int, end int, words binary"


def _open_task(window: int):
    """Single edges of the branching segments, and digests of the paths (as rows with a length of 0).

    edge is a path's print in such a row. Places of one edge in a segment that touch are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, asked = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy(), batch.column("asked")
            cuts, part = asked.offsets.to_numpy(), asked.values
            seeds, names, ats, counts, totals = (part.field(x).to_numpy(zero_copy_only=False) for x in ("seed", "print", "at", "edges", "total"))
            forks = part.field("fork").to_numpy(zero_copy_only=False)
            for w in K.words(batch.column("text")):
                plain = _Plain(w)
                asks = np.arange(cuts[w.rows.start], cuts[w.rows.stop])
                rows = np.repeat(np.arange(len(w.rows)), np.diff(cuts[w.rows.start : w.rows.stop + 1]))
                whole = totals[asks] > 0
                own, row = asks[whole], rows[whole]
                first = w.first[row] + ats[own]
                words = [plain.digest(a, b) for a, b in zip(first.tolist(), (first + totals[own] + window - 1).tolist(), strict=True)]
                yield _opened(seeds[own], names[own], ids[w.rows.start + row], prints[w.rows.start + row], ats[own], ats[own] * 0, ats[own] * 0, words)
                own, row = asks[forks[asks]], rows[forks[asks]]
                count, at = counts[own], ats[own]
                which = np.repeat(np.arange(len(own)), count)
                place = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                begin = w.first[row[which]] + place
                edge = K.unsigned(K._ranges(w.hashes, begin, begin + window, K._WORD_BASE + 2)) if len(begin) else np.empty(0, np.int64)
                order = np.lexsort((place, edge, which))
                which, edge, place, begin = which[order], edge[order], place[order], begin[order]
                head = np.ones(len(order), bool)
                head[1:] = (which[1:] != which[:-1]) | (edge[1:] != edge[:-1]) | (place[1:] - place[:-1] > window)
                start = np.flatnonzero(head)
                last = np.r_[start[1:], len(order)] - 1 if len(start) else start
                path, row = which[start], w.rows.start + row[which[start]]
                words = [plain.digest(a, a + window) for a in begin[start].tolist()]
                yield _opened(seeds[own][path], edge[start], ids[row], prints[row], at[path], place[start] - at[path], place[last] + window - at[path], words)

    return run


def _opened(seed, edge, doc_id, row, source_at, begin, end, words) -> pa.RecordBatch:
    numbers = [pa.array(np.asarray(x, np.int64)) for x in (seed, edge, doc_id, row)] + [pa.array(np.asarray(x, np.int32)) for x in (source_at, begin, end)]
    return pa.record_batch([*numbers, pa.array(words, pa.binary())], names=["seed", "edge", "doc_id", "row", "source_at", "begin", "end", "words"])


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return docs.withColumn("row", F.xxhash64("text"))


def _paths(classes: DataFrame) -> DataFrame:
    """classes that are the first segment of a path (total: its edges) that a later document repeats, or branch (fork)."""
    forks = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("prints")).where("prints > 1").select("seed", F.lit(True).alias("fork"))
    some = classes.join(forks, "seed", "left").where("places > 1 or fork")
    along = Window.partitionBy("doc_id", "row").orderBy("at")
    joins = (F.lag("next").over(along) == F.col("print")) & (F.lag("places").over(along) == F.col("places")) & (F.lag(F.col("at") + F.col("edges")).over(along) == F.col("at"))
    some = some.withColumn("opens", ~F.coalesce(joins, F.lit(False)))
    some = some.withColumn("path", F.sum(F.col("opens").cast("int")).over(along))
    total = F.sum("edges").over(Window.partitionBy("doc_id", "row", "path"))
    repeats = F.col("opens") & (F.col("last_id") > F.col("doc_id"))
    some = some.withColumn("total", F.when(repeats, total).otherwise(0).cast("int")).withColumn("fork", F.coalesce("fork", F.lit(False)))
    return some.where("total > 0 or fork").select("seed", "print", "doc_id", "row", "at", "edges", "total", "fork")


def repeated_spans(docs: DataFrame, window: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, row, start, stop, source_id, source_at, checked, words: runs of words that also start in a document with a smaller id.

    start counts words from 0, stop is exclusive; source_id is the smallest id with
    the same path or edge, source_at the place there; words is a digest of the
    first `checked` words there (all of a path, one window of an edge that goes on
    repeating). row is xxhash64 of the text: rows with one id are documents of
    their own, and what they share with each other only is no repeat. One row per
    path or single edge, so rows of a document overlap; merged, they cover exactly
    the words of repeated windows. Rows without an id or with fewer than `window`
    words have none. Equal rows have equal spans. Other columns are not read.
    """
    docs, spark = _keyed(docs).where("doc_id is not null"), docs.sparkSession
    found, found_at = stored(docs.mapInArrow(_segment_task(window, seed), _SEGMENTS), "segments")
    place = F.min(F.struct("doc_id", "row", "at")).alias("place")
    classes = found.groupBy("seed", "print").agg(place, F.first("edges").alias("edges"), F.count(F.lit(1)).alias("places"), F.max("doc_id").alias("last_id"), F.min("next").alias("low"), F.max("next").alias("high"))
    following = F.when((F.col("places") > 1) & (F.col("low") == F.col("high")), F.col("low")).alias("next")
    classes, classes_at = stored(classes.select("seed", "print", "place.*", "edges", "places", "last_id", following), "classes")
    paths, paths_at = stored(_paths(classes), "paths")
    discard(spark, classes_at)
    asked = paths.groupBy("doc_id", "row").agg(F.collect_list(F.struct("seed", "print", "at", "edges", "total", "fork")).alias("asked"))
    opened, _ = stored(docs.join(asked, ["doc_id", "row"]).mapInArrow(_open_task(window), _OPENED), "opened")

    digests = opened.where("end = 0").groupBy("seed", F.col("edge").alias("print")).agg(F.first("words").alias("words"))
    known = paths.join(digests, ["seed", "print"], "left").select("seed", "print", F.col("doc_id").alias("source_id"), F.col("row").alias("source_row"), F.col("at").alias("source_at"), "total", "fork", "words")
    later = found.drop("edges", "next").join(known, ["seed", "print"])
    other = "doc_id = source_id and fork and (row <> source_row or at <> source_at)"
    later, _ = stored(later.where(f"doc_id > source_id and total > 0 or {other}").drop("print"), "later")
    for path in (found_at, paths_at):
        discard(spark, path)
    length = (F.col("total") + (window - 1)).cast("int")
    whole = later.where("doc_id > source_id").select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + length).alias("stop"), "source_id", "source_at", length.alias("checked"), "words")

    edges = opened.where("end > 0")
    first = F.min(F.struct("doc_id", (F.col("source_at") + F.col("begin")).alias("at"), "words")).alias("first")
    owners = edges.groupBy("seed", "edge").agg(first, F.max("doc_id").alias("last_id")).where("first.doc_id < last_id").select("seed", "edge", "first")
    single = edges.drop("words").join(owners, ["seed", "edge"]).where("doc_id > first.doc_id").drop("edge")
    # Other places of an opened segment in documents with the id of the one that it was opened in.
    again = later.where(other).select("seed", F.col("source_id").alias("doc_id"), F.col("source_row").alias("row"), "source_at", F.struct("row", "at").alias("place"))
    own = single.withColumn("place", F.struct("row", F.col("source_at").alias("at")))
    single = own.unionByName(single.join(again, ["seed", "doc_id", "row", "source_at"]))
    single = single.select(
        "doc_id", F.col("place.row").alias("row"), (F.col("place.at") + F.col("begin")).alias("start"), (F.col("place.at") + F.col("end")).alias("stop"),
        F.col("first.doc_id").alias("source_id"), F.col("first.at").alias("source_at"), F.lit(window).alias("checked"), F.col("first.words").alias("words"),
    )
    return whole.unionByName(single)


def _remove_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").fill_null([])
        cuts, part = spans.offsets.to_numpy(), spans.values
        starts, stops, checked = (part.field(x).to_numpy() for x in ("start", "stop", "checked"))
        claims = part.field("words")
        for w in K.words(batch.column("text")):
            depth = np.zeros(len(w.hashes) + 1, np.int64)
            plain = _Plain(w)
            for i, row in enumerate(w.rows):
                for j in range(cuts[row], cuts[row + 1]):
                    start, most = int(w.first[i] + starts[j]), int(w.first[i + 1])
                    if start + checked[j] <= most and plain.digest(start, int(start + checked[j])) == claims[j].as_py():
                        depth[start] += 1
                        depth[min(int(w.first[i] + stops[j]), most)] -= 1
            keep = np.cumsum(depth[:-1]) == 0
            kept = np.r_[0, np.cumsum(keep)][w.first]
            size = (w.ends - w.starts + 1)[keep]
            at = np.r_[0, np.cumsum(size)][kept]
            text = np.frombuffer(plain.text, np.uint8)[np.repeat(keep, w.ends - w.starts + 1)].tobytes()
            texts = [text[a : b - 1] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            sizes = np.diff(w.first)
            yield pa.record_batch([batch.column("doc_id").slice(w.rows.start, len(w.rows)), pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(kept), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs: its words outside the spans, joined by one space.

    A span counts if the words at its place have the digest of those at its source.
    Null text counts as no words and gives an empty kept_text. A row without an id
    keeps all words; rows that share an id have their own spans each, equal rows
    equal ones. Other columns are not read.
    """
    lists = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop", "checked", "words")).alias("spans"))
    return _keyed(docs).join(lists, ["doc_id", "row"], "left").mapInArrow(_remove_task, "doc_id long, n_words long, n_removed long, kept_text string")
