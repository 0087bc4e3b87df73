"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct k-word shingles (A-Z lower-cased; fewer than k
words: the whole sequence is one shingle; no words: empty, linked with nothing).
Each shingle drives a Poisson process whose points fall on random registers; a
register keeps the smallest arrival of any shingle, stored as its truncated
exponent. Registers of a union are the maxima of registers, and two sets agree
in a register with about their Jaccard similarity.

1. Equal sets collapse to the smallest document id.
2. Bands of registers give buckets; buckets that share documents form clusters.
3. Inside a cluster, pairs that share a bucket are estimated by the joint
   likelihood of their registers and the survivors are verified on full sets.
4. Verified links form components.

Only links that join different components are searched for, so large groups
need few comparisons: every member is compared with a pivot, and those that the
pivot does not link are compared with everything that shares a bucket. A cluster
that is too large for a task is compared inside blocks, in which documents with
the same largest bucket stay together; then each component's first document in a
bucket with the bucket's pivot; and last, in buckets that still hold several
components, the documents outside the largest one with the others. Blocks of a
group of near copies become one component in the second step, so the work follows
the documents that are not linked, not the group.

Different sets of which one has n elements have a similarity of n / (n + 1) at
most: sets too small for the threshold take no part in the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, cut, ragged

REGISTERS = 512
BASE = 1.02
LEVELS = 4000
#: Largest accepted chance that a pair at the threshold shares no band.
MISS = 1e-7
#: A pair goes on to verification unless its likelihood falls at (threshold - SLACK).
SLACK = 0.1
#: Points that a step generates at most, unless it has more elements.
STEP_POINTS = 30_000
#: Shingles and documents of one block of a cluster; larger clusters are compared block by block.
BLOCK_SHINGLES = 6_000_000
BLOCK_DOCUMENTS = 1_000


def band_rows(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band can have without missing a pair at the threshold."""
    fits = [r for r in range(1, registers + 1) if (1 - threshold**r) ** (registers // r) <= miss]
    return max(fits)


def sketch(values: np.ndarray, rows: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """uint16 registers [n_rows, registers] of the distinct (value, row) pairs given; rows ascend.

    Point j of an element comes a random while after point j - 1 and falls on a
    random register, both by hashes of (value, j). An element is done once its
    points come later than all minima of its row; few elements take many points at once.
    """
    low = np.full(n_rows * registers, np.inf)
    now, cell, state = np.zeros(len(values)), rows.astype(np.int64) * registers, K.mix(values ^ np.uint64(0x1B873593CC9E2D51))
    done, step = 0, np.uint64(0x9E3779B97F4A7C15)
    while len(state):
        many = int(np.clip(STEP_POINTS // len(state), 1, 512))
        points = K.mix(state[:, None] + np.arange(done + 1, done + many + 1, dtype=np.uint64) * step)
        gaps = np.log(((points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = now[:, None] - np.cumsum(gaps, axis=1) / registers
        register = (points * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        np.minimum.at(low, (cell[:, None] + register.astype(np.int64)).ravel(), times.ravel())
        now, done = times[:, -1], done + many
        which = np.unique(cell)
        worst = np.zeros(n_rows)
        worst[which // registers] = low.reshape(n_rows, registers)[which // registers].max(axis=1)
        alive = now < worst[cell // registers]
        state, now, cell = state[alive], now[alive], cell[alive]
    low = low.reshape(n_rows, registers)
    with np.errstate(divide="ignore"):
        level = np.floor(LEVELS / 2 - np.log(low) / math.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0), 0, LEVELS).astype(np.uint16)


def likely(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray, at: float) -> np.ndarray:
    """Whether the joint likelihood of the registers still rises at similarity `at`, so its maximum is higher."""
    more = (one > many).sum(axis=-1)
    less = (one < many).sum(axis=-1)
    same = many.shape[-1] - more - less
    u = n_one / (n_one + n_many)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    c = (BASE - 1) / BASE
    with np.errstate(invalid="ignore", divide="ignore"):
        x, y = 1 - c * (u - v * at), 1 - c * (v - u * at)
        p, q = -np.log(x) / math.log(BASE), -np.log(y) / math.log(BASE)
        dp, dq = -v * c / x / math.log(BASE), -u * c / y / math.log(BASE)
        slope = more * dp / p + less * dq / q - same * (dp + dq) / (1 - p - q)
    return np.where(top < at, False, (slope >= 0) | (more + less == 0))


def estimate(one: np.ndarray, other: np.ndarray, n_one: int, n_other: int) -> float:
    """Similarity at which the joint likelihood of two sketches is largest, by bisection of its slope."""
    low, high = 0.0, min(n_one / n_other, n_other / n_one)
    sizes = np.array([n_other], float)
    if (one == other).all():
        return high
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if likely(one, other[None, :], n_one, sizes, middle)[0] else (low, middle)
    return (low + high) / 2


def _unique(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[first], rows[first]


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, sorted shingle hashes, cuts) of runs of rows."""
    for w in K.words(texts, lower=True, limit=K.SLICE_BYTES):
        values, rows = _unique(*w.shingles(k))
        yield w.rows, values, np.searchsorted(rows, np.arange(len(w.rows) + 1))


_SKETCHES = "doc_id long, n_shingles long, print_a long, print_b long, keys array<long>"


def _sketch_task(k: int, rows_per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // rows_per_band
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, values, cuts in _sets(batch.column("text"), k):
                sizes = np.diff(cuts)
                sums = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(K.mix(values), out=sums[0, 1:])
                np.cumsum(K.mix(~values), out=sums[1, 1:])
                prints = sums[:, cuts[1:]] - sums[:, cuts[:-1]]
                full = np.flatnonzero(sizes)
                keys = band_keys(_registers(values, cuts)[full], rows_per_band)
                ends = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))]
                columns = [ids.slice(rows.start, len(rows)), pa.array(sizes, pa.int64()), pa.array(K.unsigned(prints[0])), pa.array(K.unsigned(prints[1])), ragged(K.unsigned(keys.ravel()), ends)]
                yield pa.record_batch(columns, names=["doc_id", "n_shingles", "print_a", "print_b", "keys"])

    return run


def _registers(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Registers of each row's set; zeros for an empty one."""
    sizes = np.diff(cuts)
    full = np.flatnonzero(sizes)
    table = np.zeros((len(sizes), REGISTERS), np.uint16)
    if len(full):
        table[full] = sketch(values, np.repeat(np.arange(len(full)), sizes[full]), len(full))
    return table


def band_keys(table: np.ndarray, rows_per_band: int) -> np.ndarray:
    """uint64 [n, bands]: a hash of each band's registers and the band's number."""
    bands = REGISTERS // rows_per_band
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(table), bands)).copy()
    cells = table[:, : bands * rows_per_band].reshape(len(table), bands, rows_per_band).astype(np.uint64)
    for j in range(rows_per_band):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return key


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above


def links(ids: np.ndarray, values: np.ndarray, cuts: np.ndarray, table: np.ndarray, rows_per_band: int, percent: int, slack: float, labels: np.ndarray | None = None, few: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that span the components among the rows.

    After a bucket, any two of its rows are in one component or were compared,
    so a pair that shared an earlier bucket is never looked at again. Rows with
    one label are in one component from the start. With few, only rows where it
    is true are compared with rows where it is false.
    """
    n, sizes = len(ids), np.diff(cuts)
    forest, found, keys = _Forest(n), [], band_keys(table, rows_per_band)
    if labels is not None:
        _, first, at = np.unique(labels, return_index=True, return_inverse=True)
        forest.up = first[at]
    codes = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(len(codes) + 1, bool)

    def compare(x: int, others: np.ndarray, band: int) -> None:
        others = others[~(keys[others, :band] == keys[x, :band]).any(axis=1)]
        hopeful = [likely(table[x], table[part], int(sizes[x]), sizes[part].astype(float), percent / 100 - slack) for part in np.array_split(others, len(others) // 4096 + 1)]
        others = others[np.concatenate(hopeful)]
        if not len(others):
            return
        own = codes[cuts[x] : cuts[x + 1]]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[codes[cuts[y] : cuts[y + 1]]]) for y in others])
        mark[own] = False
        for y in others[(shared > 0) & (100 * shared >= percent * (sizes[x] + sizes[others] - shared))]:
            if forest.join(x, int(y)):
                found.append((int(ids[x]), int(ids[y])))

    for band in range(keys.shape[1]):
        order = np.argsort(keys[:, band], kind="stable")
        edges = np.flatnonzero(np.diff(keys[order, band])) + 1
        for members in np.split(order, edges):
            if len(members) < 2:
                continue
            roots = forest.roots()[members]
            if (roots == roots[0]).all():
                continue
            if few is not None:
                many = members[~few[members]]
                for x in members[few[members]]:
                    roots = forest.roots()
                    compare(int(x), many[roots[many] != roots[x]], band)
                continue
            heads, at, counts = np.unique(roots, return_inverse=True, return_counts=True)
            pivot = int(members[at == counts.argmax()][0])
            compare(pivot, members[roots != heads[counts.argmax()]], band)
            roots = forest.roots()[members]
            rest = members[roots != forest.root(pivot)]
            left = members[members != pivot]
            for x in rest:
                left = left[left != x]
                roots = forest.roots()
                compare(int(x), left[roots[left] != roots[x]], band)
    return found


_LINKS = "a long, b long"


def _link_task(k: int, rows_per_band: int, percent: int, slack: float):
    """Links inside a block; with the columns label and few, those that are still to be found."""

    def run(group: pa.Table) -> pa.Table:
        parts = list(_sets(group["text"], k))
        values = np.concatenate([v for _, v, _ in parts])
        cuts = np.r_[0, np.cumsum(np.concatenate([np.diff(c) for _, _, c in parts]))]
        table = np.concatenate([_registers(v, c) for _, v, c in parts])
        labels, few = (group[c].to_numpy() for c in ("label", "few")) if "few" in group.column_names else (None, None)
        found = links(group["doc_id"].to_numpy(), values, cuts, table, rows_per_band, percent, slack, labels, few)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _pair_task(k: int, percent: int, rows: int = 64):
    """Those of the pairs (a, text_a, b, text_b) that are linked."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [x for _, values, cuts in _sets(texts, k) for x in np.split(values, cuts[1:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                pairs = list(zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True))
                shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs])
                total = np.array([len(x) + len(y) for x, y in pairs])
                yield part.select(["a", "b"]).filter(pa.array((shared > 0) & (100 * shared >= percent * (total - shared))))

    return run


def _open_buckets(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of the buckets of keyed(doc_id, cluster, keys) that hold several components, with label, home and pivot.

    home is the component with the most documents in the bucket, pivot its smallest one there.
    """
    labels = components(found).withColumnRenamed("node", "doc_id")
    own = keyed.join(labels, "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("label"), F.explode("keys").alias("key"))
    held = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("head"))
    homes = held.groupBy("key").agg(F.max(F.struct("n", "head", "label")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return own.join(homes.select("key", F.col("most.label").alias("home"), F.col("most.head").alias("pivot")), "key")


def _pivot_pairs(opened: DataFrame) -> DataFrame:
    """(a, b): a bucket's pivot, and the first document there of each other component."""
    heads = opened.where("label <> home").groupBy("key", "label").agg(F.min("doc_id").alias("b"), F.min("pivot").alias("a"))
    return heads.select("a", "b").distinct()


def _parts(shingles, documents, block_shingles: int, block_documents: int):
    """Blocks for so many shingles and documents."""
    return F.ceil(F.greatest(shingles / block_shingles, documents / block_documents)).cast("int")


def _grid(opened: DataFrame, totals: DataFrame, block_shingles: int, block_documents: int) -> DataFrame:
    """doc_id, label, few, cluster, cell: blocks of documents outside a bucket's home (few) against blocks of all in open buckets."""
    rows = opened.groupBy("doc_id", "cluster", "label").agg(F.bool_or(F.col("label") != F.col("home")).alias("strays"))
    rows = rows.join(totals.withColumnRenamed("node", "doc_id"), "doc_id")
    high = _parts(F.sum(F.when(F.col("strays"), F.col("n"))), F.count_if("strays"), block_shingles, block_documents)
    wide = _parts(F.sum("n"), F.count(F.lit(1)), block_shingles, block_documents)
    blocks = rows.groupBy("cluster").agg(high.alias("high"), wide.alias("wide"))
    rows = rows.join(blocks, "cluster")

    def dealt(few: bool) -> DataFrame:
        own, other = ("high", "wide") if few else ("wide", "high")
        block, across = F.pmod(F.xxhash64("doc_id"), F.col(own)), F.sequence(F.lit(0), F.col(other) - 1)
        cells = F.transform(across, lambda x: block * F.col("wide") + x if few else x * F.col("wide") + block)
        return (rows.where("strays") if few else rows).select("doc_id", "label", F.lit(few).alias("few"), "cluster", F.explode(cells).alias("cell"))

    return dealt(True).unionByName(dealt(False))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, slack: float = SLACK, block_shingles: int = BLOCK_SHINGLES, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets. component_id is the smallest doc_id reachable. Rows that share a
    doc_id are one document with several texts. Without doc_id a row stands alone:
    component_id null, kept. Ties do not arise: ids decide. Other columns are not
    read, so their names do not matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_per_band = band_rows(percent / 100)
    sketches = cut(docs.mapInArrow(_sketch_task(k, rows_per_band), _SKETCHES), "sketches")
    prints = ["n_shingles", "print_a", "print_b"]
    filled = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    linkable = f"n_shingles * {100 - percent} >= {percent}"
    reps = classes.where(linkable).join(filled.withColumnRenamed("doc_id", "rep"), [*prints, "rep"]).select(F.col("rep").alias("doc_id"), "n_shingles", "keys")
    same = filled.drop("keys").join(classes, prints).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("size")).where("a < z")
    own = keyed.join(shared.drop("z"), "key").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("doc_id") != F.col("a"), F.col("a")))).alias("a"), F.max(F.struct("size", "key")).alias("home"))
    own = cut(own, "pivots")
    # Its smallest pivot linked to the others and to the document: as connected as links to each pivot, but mostly the same ones in a group.
    star = F.explode(F.concat(F.slice("a", 2, F.size("a")), F.array("doc_id")))
    candidates = own.where(F.size("a") > 0).select(F.get("a", F.lit(0)).alias("a"), star.alias("b")).distinct()
    clusters = components(candidates)

    totals = sketches.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("n"))
    sizes = clusters.join(totals, "node").groupBy("component").agg(_parts(F.sum("n"), F.count(F.lit(1)), block_shingles, block_documents).alias("parts"))
    # Documents with one largest bucket share a block, or as many as that bucket needs by itself.
    within = F.pmod(F.xxhash64("node"), F.ceil(F.col("home.size") / block_documents))
    block = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("home.key", within), F.col("parts"))).otherwise(0).cast("int")
    placed = clusters.join(sizes, "component").join(own.select(F.col("doc_id").alias("node"), "home"), "node")
    placed = placed.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "parts", block.alias("block"))
    task = _link_task(k, rows_per_band, percent, slack)
    found = docs.join(placed.drop("parts"), "doc_id").groupBy("cluster", "block").applyInArrow(task, _LINKS).union(same)
    if not sizes.where("parts > 1").isEmpty():
        found = cut(found, "links")
        wide = reps.select("doc_id", "keys").join(placed.where("parts > 1").select("doc_id", "cluster"), "doc_id")
        pairs = _pivot_pairs(_open_buckets(wide, found))
        texts = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        found = cut(found.union(texts.mapInArrow(_pair_task(k, percent), _LINKS)), "links")
        left = _grid(cut(_open_buckets(wide, found), "open"), totals, block_shingles, block_documents)
        found = found.union(docs.join(left, "doc_id").groupBy("cluster", "cell").applyInArrow(task, _LINKS))
    joined = components(found)
    labelled = sketches.drop("keys").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
