"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct k-word shingles (A-Z lower-cased; fewer than k
words: the whole sequence is one; no words: empty, linked with nothing). Shingles
are ordered by their 64-bit hash, and this order is cut into 2^level fragments.

Candidates. Two sets that differ in d shingles differ in d fragments at most, so
of F > d fragments F - d hold the same shingles in both. A document keeps the
d + 1 of its fragments that come first in one order of all fragments, rarest
first; the first fragment that both share is among them for both. The level
follows from the smaller set's size; a larger set takes part in the levels of
all sizes that it may be linked with. How frequent a shingle is comes from a
table of counters over all documents, of fixed size; it decides the order only.
A document with d or fewer fragments that are not empty gives its single
shingles as well, as two such documents may share empty fragments alone.

Links. A pair's overlap is counted in each fragment by itself, of a cut that
keeps fragments small, and summed over the fragments.

Components. Only links between different components are needed. Every document
is compared with one pivot of its buckets; then, in buckets that hold several
components, one node of each with one of the largest; and last every document
outside a bucket's largest component with all the others' there. These are not
listed as pairs, as near copies around the threshold would be nearly all pairs of
their group: tasks get blocks of such documents against blocks of all, add up the
overlaps fragment by fragment, stop where the rest cannot suffice, and give the
links alone. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, cut, ragged, stored
from .near_dedup import _sets
from .shards import Shards, written

#: Counters of shingles: 2^18 numbers, whatever the input.
COUNTER_BITS = 18
#: Shingles of a fragment when overlaps are counted, about.
FRAGMENT = 1024
SHARD_ROWS = 2_000_000
#: Rounds in which components of a bucket meet at single nodes before all their nodes do.
ROUNDS = 2
#: Nodes and shingles of a block in the last comparison, and fragments in which a task adds up overlaps.
BLOCK_NODES = 1_000
BLOCK_SHINGLES = 2_000_000
PARTS = 8


def may_differ(sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles a set of this size may differ from one that it is linked with."""
    return (sizes + 100 * sizes // percent) * (100 - percent) // (100 + percent)


def level_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Two raised to it is between 1.4 and 2.9 times the fragments kept: few shingles in one, and rare ones to choose."""
    return np.maximum(np.rint(np.log2(2.0 * (may_differ(sizes, percent) + 1))), 1).astype(np.int64)


def _count_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for w in K.words(batch.column("text"), lower=True):
                counts += np.bincount((w.shingles(k)[0] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used])], names=["slot", "n"])

    return run


def counters(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all documents have each of the first COUNTER_BITS bits; the driver gets at most that many rows."""
    found = docs.mapInArrow(_count_task(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def _prints(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(K.mix(values), out=sums[0, 1:])
    np.cumsum(K.mix(~values), out=sums[1, 1:])
    return K.unsigned(sums[:, cuts[1:]] - sums[:, cuts[:-1]])


def kept_fragments(values: np.ndarray, cuts: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of the fragments by which sets, sorted hashes values[cuts[i]:cuts[i + 1]], are found."""
    sizes = np.diff(cuts)
    able = np.flatnonzero(sizes * (100 - percent) >= percent)
    high, low = level_of(sizes[able], percent), level_of(-(-percent * sizes[able] // 100), percent)
    keys, rows = [], []
    for back in range(int((high - low).max(initial=-1)) + 1):
        some = able[high - back >= low]
        k, r = _kept_at(values, cuts, some, level_of(sizes[some], percent) - back, percent, counts)
        keys.append(k)
        rows.append(r)
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _kept_at(values: np.ndarray, cuts: np.ndarray, some: np.ndarray, level: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(cuts)[some]
    ends = np.cumsum(sizes)
    at = np.repeat(cuts[some] - np.r_[0, ends[:-1]], sizes) + np.arange(ends[-1] if len(ends) else 0)
    own, row = values[at], np.repeat(np.arange(len(some)), sizes)
    fragment = own >> np.repeat((64 - level).astype(np.uint64), sizes)
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])]) if len(own) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    content = np.add.reduceat(K.mix(own), starts)
    rarest = np.minimum.reduceat(counts[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], starts)
    row_of = row[starts]
    key = K.mix(content + K.mix(fragment[starts] + (level[row_of].astype(np.uint64) << np.uint64(58))))
    order = np.lexsort((key, rarest, row_of))
    filled = np.bincount(row_of, minlength=len(some))
    number = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
    most = may_differ(sizes, percent) + 1
    kept = order[number < most[row_of[order]]]
    sparse = np.flatnonzero((filled < most)[row])
    single = K.mix(own[sparse] ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([key[kept], single]), some[np.concatenate([row_of[kept], row[sparse]])]


_ROWS = "row_id long, doc_id long, row_hash long, n_shingles long, print_a long, print_b long, keys array<long>"


def _row_task(k: int, percent: int, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values, cuts in _sets(batch.column("text"), k):
                keys, owner = kept_fragments(values, cuts, percent, counts)
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(len(rows) + 1))
                named = [batch.column(c).slice(rows.start, len(rows)) for c in ("row_id", "doc_id", "row_hash")]
                prints = _prints(values, cuts)
                yield pa.record_batch([*named, pa.array(np.diff(cuts), pa.int64()), pa.array(prints[0]), pa.array(prints[1]), ragged(K.unsigned(keys[order]), ends)], names=["row_id", "doc_id", "row_hash", "n_shingles", "print_a", "print_b", "keys"])

    return run


def _fragment_levels(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n / FRAGMENT, 1))).astype(np.int64)


def _fragment_level(n):
    """The same for a column."""
    return F.ceil(F.log2(F.greatest(n / F.lit(FRAGMENT), F.lit(1.0)))).cast("int")


_SEGMENTS = "node long, level int, fragment long, grams array<long>"


def _segment_task(k: int, percent: int, wanted: Shards):
    """The wanted nodes' shingles by fragment, at each level at which the node may meet another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            place = wanted.rank(batch.column("row_hash").to_numpy())
            rows = np.flatnonzero(place >= 0)
            if not len(rows):
                continue
            texts = batch.column("text").take(pa.array(rows))
            for part, values, cuts in _sets(texts, k):
                ranks, prints = place[rows[part.start : part.stop]], _prints(values, cuts)
                for shift in (0, 1):  # two nodes may have rows of one hash
                    at = np.minimum(ranks + shift, wanted.ranks[-1] - 1)
                    same = (wanted.at(at, "print_a") == prints[0]) & (wanted.at(at, "print_b") == prints[1])
                    nodes = wanted.at(at, "node")
                    for i in np.flatnonzero(same).tolist():
                        node, own = int(nodes[i]), values[cuts[i] : cuts[i + 1]]
                        if node not in done:
                            done.add(node)
                            yield from _segments(node, own, percent)

    return run


def _segments(node: int, own: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    for level in np.unique(_fragment_levels(np.array([len(own), 100 * len(own) // percent]))).tolist():
        fragment = (own >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(own), np.int64)
        starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        many = len(starts)
        columns = [pa.array(np.full(many, node)), pa.array(np.full(many, level), pa.int32()), pa.array(fragment[starts]), ragged(K.unsigned(own), np.r_[starts, len(own)])]
        yield pa.record_batch(columns, names=["node", "level", "fragment", "grams"])


def _segments_of(docs: DataFrame, nodes: DataFrame, some: DataFrame, k: int, percent: int) -> DataFrame:
    """node, level, fragment, grams of these nodes, read from the texts of their rows."""
    wanted, _ = stored(some.join(nodes, "node").select(F.col("row_hash").alias("key"), "node", "print_a", "print_b"), "wanted")
    placed = wanted.repartitionByRange(wanted.count() // SHARD_ROWS + 1, "key").sortWithinPartitions("key", "print_a", "print_b")
    return docs.mapInArrow(_segment_task(k, percent, written(placed, "wanted", unique=False)), _SEGMENTS)


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b, n_a, n_b) whose overlap, counted in each fragment and summed, is large enough; stored."""
    segments = _segments_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k, percent)
    # A row that repeats gives its node's fragments again; a pair's overlap in a fragment is the same each time.
    one = pairs.withColumn("level", _fragment_level(F.greatest("n_a", "n_b"))).join(segments.select(F.col("node").alias("b"), "level", "fragment", F.col("grams").alias("grams_b")), ["b", "level"])
    two = one.join(segments.select(F.col("node").alias("a"), "level", "fragment", F.col("grams").alias("grams_a")), ["a", "level", "fragment"])
    partial = two.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared"))
    each = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("shared").alias("shared"))
    total = each.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return cut(total.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"), "links")


def _sized(percent: int):
    """Whether sets of n_a and n_b shingles can be linked at all."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _open(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings in buckets that hold several components, with label, and the home: the component most of the bucket's nodes are in."""
    labels = components(links).withColumnRenamed("component", "label")
    own = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many"))
    homes = held.groupBy("key").agg(F.max(F.struct("many", "label")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return own.join(homes.select("key", F.col("most.label").alias("home")), "key")


def _met(open_: DataFrame, number: int) -> DataFrame:
    """In each bucket one node of every component beside its home, and one of the home; other ones in each round."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(number), "node"), "node", "n"))
    one = open_.groupBy("key", "label", "home").agg(drawn.alias("one"))
    home = one.where("label = home").select("key", F.col("one").alias("host"))
    return one.where("label <> home").join(home, "key").select(*_ordered(F.struct("one.node", "one.n"), F.struct("host.node", "host.n")))


def _cells(open_: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """node, n, label, few, keys, cluster, cell: blocks of nodes outside a home (few) against blocks of all nodes that their buckets connect."""
    own = cut(open_.groupBy("node", "n", "label").agg(F.bool_or(F.col("label") != F.col("home")).alias("strays"), F.collect_set("key").alias("keys")), "members")
    first = open_.groupBy("key").agg(F.min("node").alias("a"))
    clusters = components(open_.join(first, "key").select("a", F.col("node").alias("b")).distinct())
    own = own.join(clusters.withColumnRenamed("component", "cluster"), "node")

    def parts(which):
        many, shingles = F.count_if(which), F.sum(F.when(which, F.col("n")))
        return F.ceil(F.greatest(many / block_nodes, shingles / block_shingles)).cast("int")

    own = own.join(own.groupBy("cluster").agg(parts(F.col("strays")).alias("high"), parts(F.lit(True)).alias("wide")), "cluster")

    def dealt(few: bool) -> DataFrame:
        mine, other = ("high", "wide") if few else ("wide", "high")
        block, across = F.pmod(F.xxhash64("node"), F.col(mine)), F.sequence(F.lit(0), F.col(other) - 1)
        cells = F.transform(across, lambda x: block * F.col("wide") + x if few else x * F.col("wide") + block)
        return (own.where("strays") if few else own).select("node", "n", "label", F.lit(few).alias("few"), "keys", "cluster", F.explode(cells).alias("cell"))

    return dealt(True).unionByName(dealt(False))


class _Sets:
    """Nodes of a cell with their shingles as places in the cell's order, and where that order's parts begin in each."""

    def __init__(self, rows: pa.Table):
        grams = rows["grams"].combine_chunks()
        sizes, flat = grams.value_lengths().to_numpy(), grams.flatten().to_numpy().view(np.uint64)
        self.nodes, first, at = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
        self.labels, self.sizes = rows["label"].to_numpy()[first], rows["n"].to_numpy()[first]
        self.keys = [rows["keys"][int(i)].values.to_numpy() for i in first]
        owner = np.repeat(at, sizes)
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        # Fragments of rows that repeat are there more than once.
        kept = np.r_[True, (owner[1:] != owner[:-1]) | (flat[1:] != flat[:-1])] if len(flat) else np.empty(0, bool)
        flat, owner = flat[kept], owner[kept]
        every, self.codes = np.unique(flat, return_inverse=True)
        self.many = len(every)
        steps = np.linspace(0, self.many, PARTS + 1).astype(np.int64)
        # Codes of a node ascend, and so do owner * many + code.
        spread = owner * self.many + self.codes
        self.cuts = np.searchsorted(spread, (np.arange(len(self.nodes)) * self.many)[:, None] + steps[None, :])


def _overlaps(sets: _Sets, mark: np.ndarray, x: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of the others that are linked with x, whose shingles are marked."""
    need = -(-percent * (sets.sizes[x] + sets.sizes[others]) // (100 + percent))
    total = np.zeros(len(others), np.int64)
    for part in range(PARTS):
        starts, stops = sets.cuts[others, part], sets.cuts[others, part + 1]
        sizes = stops - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - np.r_[0, ends[:-1]], sizes) + np.arange(ends[-1])
        held = np.r_[0, np.cumsum(mark[sets.codes[at]])]
        total += held[ends] - held[ends - sizes]
        left = np.minimum(sets.cuts[others, PARTS] - stops, sets.cuts[x, PARTS] - sets.cuts[x, part + 1])
        hopeful = total + left >= need
        others, total, need = others[hopeful], total[hopeful], need[hopeful]
        if not len(others):
            break
    return others


def _cell_task(percent: int):
    """Links (a, b) between the components of a cell."""

    def run(group: pa.Table) -> pa.Table:
        sets, few = _Sets(group), np.unique(group["node"].to_numpy()[group["few"].to_numpy(zero_copy_only=False)])
        wide = np.isin(sets.nodes, np.unique(group["node"].to_numpy()[~group["few"].to_numpy(zero_copy_only=False)]))
        holders: dict[int, list[int]] = {}
        for i in np.flatnonzero(wide).tolist():
            for key in sets.keys[i].tolist():
                holders.setdefault(key, []).append(i)
        labels, mark, found = sets.labels.copy(), np.zeros(sets.many, bool), []
        for x in np.searchsorted(sets.nodes, few).tolist():
            others = np.unique(np.concatenate([np.array(holders.get(key, ()), np.int64) for key in sets.keys[x].tolist()]))
            small, large = np.minimum(sets.sizes[others], sets.sizes[x]), np.maximum(sets.sizes[others], sets.sizes[x])
            others = others[(labels[others] != labels[x]) & (100 * small >= percent * large)]
            if not len(others):
                continue
            own = sets.codes[sets.cuts[x, 0] : sets.cuts[x, PARTS]]
            mark[own] = True
            for y in _overlaps(sets, mark, x, others, percent).tolist():
                if labels[y] != labels[x]:
                    found.append((int(sets.nodes[x]), int(sets.nodes[y])))
                    labels[labels == labels[y]] = labels[x]
            mark[own] = False
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _ordered(a, b) -> list:
    """Columns of a pair of (node, n) structs, the smaller node first."""
    first, second = F.least(a, b), F.greatest(a, b)
    return [first["node"].alias("a"), second["node"].alias("b"), first["n"].alias("n_a"), second["n"].alias("n_b")]


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = ROUNDS, block_nodes: int = BLOCK_NODES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two rows are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets, which must not be empty. component_id is the smallest doc_id
    reachable, the row's own included. Rows that share an id are documents of
    their own; rows without an id link others, and their component_id is null if
    they reach no row with one. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    counts = counters(docs, k)
    rows = cut(docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_row_task(k, percent, counts), _ROWS), "rows")
    prints = ["n_shingles", "print_a", "print_b"]
    filled = rows.where("n_shingles > 0")
    classes = cut(filled.groupBy(*prints).agg(F.min("row_id").alias("node")), "classes")
    own = rows.select(F.col("row_id").alias("node"), "row_hash", *prints, "keys").join(classes.select("node"), "node")
    nodes = own.select("node", "row_hash", "print_a", "print_b")
    spread = own.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n")).distinct()
    shared = spread.groupBy("key").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count(F.lit(1)).alias("many")).where("many > 1")
    postings = cut(spread.join(shared.drop("many"), "key"), "postings")

    tries = postings.where("node <> pivot.node").groupBy("node", "n", "pivot").agg(F.count(F.lit(1)).alias("many"))
    tries = tries.select(*_ordered(F.struct("node", "n"), F.col("pivot")), "node", "many").where(_sized(percent))
    tried = cut(tries.groupBy("node").agg(F.max(F.struct("many", "a", "b", "n_a", "n_b")).alias("x")).select("x.a", "x.b", "x.n_a", "x.n_b").distinct(), "pairs")
    links = _linked(docs, nodes, tried, k, percent)
    postings = postings.drop("pivot")
    for number in range(rounds):
        met = _met(_open(postings, links), number)
        fresh = cut(met.where(_sized(percent)).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            break
        found = _linked(docs, nodes, fresh, k, percent)
        links, tried = cut(links.union(found), "links"), cut(tried.union(fresh), "pairs")
        if found.isEmpty():
            break
    open_ = cut(_open(postings, links), "open")
    if not open_.isEmpty():
        cells = cut(_cells(open_, block_nodes, block_shingles), "cells").withColumn("level", _fragment_level(F.col("n")))
        segments = _segments_of(docs, nodes, cells.select("node").distinct(), k, percent)
        met = cells.join(segments.drop("fragment"), ["node", "level"]).drop("level")
        links = cut(links.union(met.groupBy("cluster", "cell").applyInArrow(_cell_task(percent), "a long, b long")), "links")

    labels = components(links)
    named = rows.drop("keys", "row_hash").join(classes, prints, "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node", -1 - F.col("row_id")))
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(lowest, "component").select("doc_id", "n_shingles", "component_id")
