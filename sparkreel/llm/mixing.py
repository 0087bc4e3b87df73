"""Temperature mixing of sources, in DataFrame functions only.

A source with share p of all tokens gets a weight in proportion to p**a. The
exponent a lies between 1 (natural shares) and 0 (equal shares) and is bisected:
the smallest exponent whose weights have at most the target entropy and draw no
source more often than the repetition limit. Each source then has a budget of
tokens. It is realised as whole passes over the source and one partial pass.

In a pass, documents come in permuted blocks: blocks in the order of a hash of
source, pass and block, documents in a block in the order of a hash of pass and
document. A document is known by the hash of its row and its number among equal
rows, so rows without ids, with one id or with one text are dealt like others. The partial pass takes whole blocks while they fit and documents of
the next block while they fit. So the plan is one row a source: its passes, the
block at which the partial pass ends and the last document key there.

Blocks hold about BLOCK_TOKENS tokens and sums run over slices of about
SLICE_BLOCKS blocks, then over a source's slices: no sum covers a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, stored

BLOCK_TOKENS = 200_000
#: Exponents tried at once; each round narrows the interval by this factor.
SECTIONS = 16
ROUNDS = 7
#: Blocks whose sizes one running sum adds up.
SLICE_BLOCKS = 10_000
#: A plan (one row a source) of more bytes is not broadcast; each source then has SALTS join keys.
BROADCAST_BYTES = 8_000_000
SALTS = 64
#: Equal rows that are numbered in one go; more are numbered in several tasks.
NUMBERS = 100_000


def token_count(text: Column) -> Column:
    """Words: runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """source, tokens, documents. A null source counts as the empty name."""
    return docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def exponent(sources: DataFrame, budget: int, entropy_gain: float, max_repeats: float) -> float:
    """The smallest exponent in [0, 1] that meets the target entropy and the repetition limit.

    Target entropy: the natural shares' entropy plus entropy_gain of what equal
    shares would add. Both conditions only get easier as the exponent grows. At 1
    every source is drawn budget / tokens times; a budget for which that is over
    the limit is an error.
    """
    shares = sources.where("tokens > 0")
    total = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if total["t"] and budget > max_repeats * total["t"] * (1 + 1e-12):
        raise ValueError(f"{budget} tokens cannot be drawn from {total['t']} with at most {max_repeats} repeats")
    if not total["t"] or total["n"] < 2:
        return 1.0
    shares = shares.select((F.col("tokens") / F.lit(float(total["t"]))).alias("p"))
    natural = shares.agg((-F.sum(F.col("p") * F.log("p"))).alias("h")).first()["h"]
    target = natural + entropy_gain * (math.log(total["n"]) - natural)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / SECTIONS
        tried = shares.select("p", F.explode(F.array(*[F.lit(low + i * step) for i in range(SECTIONS + 1)])).alias("a"))
        # With q = p**a and z = sum(q): entropy = log(z) - sum(q log q) / z; a source repeats budget * q / (z * tokens) times.
        sums = tried.select("a", "p", F.pow("p", "a").alias("q")).groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("a") * F.log("p")).alias("s"), F.max(F.col("q") / F.col("p")).alias("most"))
        meets = (F.log("z") - F.col("s") / F.col("z") <= target + 1e-12) & (F.lit(budget / total["t"]) * F.col("most") / F.col("z") <= max_repeats + 1e-12)
        good = sums.where(meets).agg(F.min("a").alias("a")).first()["a"]
        if good is None:
            return 1.0
        low, high = max(low, good - step), good
        if low == high == 0.0:
            break
    return high


def _key(*parts) -> Column:
    return F.xxhash64(*parts)


def _by_source(rows: DataFrame, table: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined to a table of one row a source: broadcast if its size allows, else with SALTS copies of it, so that a hot source is many keys."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("source") + 8 * len(table.columns)), F.lit(0)).alias("b")).first()["b"]
    if size <= most_bytes:
        return rows.join(F.broadcast(table), "source")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(_key(F.lit(1), F.col("row_a"), F.col("number")), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, ["source", "__salt"]).drop("__salt")


def _ends(blocks: DataFrame, slice_blocks: int) -> DataFrame:
    """blocks with end, the running sum of tokens of a source's blocks by (block_key, block), added up slice by slice."""
    slices = F.ceil(F.col("blocks") / slice_blocks)
    part = F.least(F.floor((F.col("block_key") / F.lit(2.0**64) + 0.5) * slices), slices - 1).cast("long")
    blocks = blocks.withColumn("part", part)
    inside = Window.partitionBy("source", "part").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    sums = sums.select("source", "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    return blocks.join(sums, ["source", "part"]).withColumn("end", F.col("before") + F.sum("tokens").over(inside)).drop("part", "before")


def plan(docs: DataFrame, budget: int | None, entropy_gain: float, max_repeats: float, block_tokens: int, seed: int, slice_blocks: int = SLICE_BLOCKS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """source, blocks, whole, edge_key, edge, last_key of numbered rows: whole passes, then the partial pass.

    It draws the blocks before (edge_key, edge) and of that block the documents up
    to last_key; without an edge it draws nothing.
    """
    spark = docs.sparkSession
    sources, sources_at = stored(source_tokens(docs), "sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    budget = total if budget is None else budget
    a = exponent(sources, budget, entropy_gain, max_repeats)
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.coalesce(F.sum(raised), F.lit(0.0)).alias("z")).first()["z"] or 1.0
    share = F.floor(raised / F.lit(z) * F.lit(float(budget))).cast("long")
    budgets = sources.select("source", "tokens", share.alias("budget")).where("tokens > 0")
    budgets = budgets.select("source", F.expr("budget div tokens").cast("int").alias("whole"), F.expr("budget % tokens").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).alias("blocks"))
    budgets, budgets_at = stored(budgets, "budgets")
    discard(spark, sources_at)
    placed = _by_source(docs, budgets, most_bytes).withColumn("block", block_of(F.col("blocks"), seed))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    blocks, blocks_at = stored(blocks.withColumn("block_key", _key(F.lit(seed), F.col("source"), F.col("whole"), F.col("block"))), "blocks")
    blocks = _ends(blocks, slice_blocks)
    room = (F.col("rest") - F.col("end") + F.col("tokens")).alias("room")
    edges = blocks.where("end > rest").groupBy("source").agg(F.min(F.struct("block_key", "block", room)).alias("edge"))
    edges, edges_at = stored(edges.select("source", F.col("edge.block_key").alias("edge_key"), F.col("edge.block").alias("edge"), "edge.room"), "edges")
    discard(spark, blocks_at)
    ahead = _by_source(docs, budgets.select("source", "whole", "blocks").join(edges, "source"), most_bytes)
    ahead = ahead.where((F.col("room") > 0) & (block_of(F.col("blocks"), seed) == F.col("edge")))
    inside = Window.partitionBy("source").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ahead.withColumn("doc_key", _doc_key(seed)).withColumn("end", F.sum("n_tokens").over(inside)).where("end <= room")
    limits = ahead.groupBy("source").agg(F.max("doc_key").alias("last_key"))
    out = budgets.join(edges.drop("room"), "source", "left").join(limits, "source", "left").select("source", "blocks", "whole", "edge_key", "edge", "last_key")
    out = cut(out, "plan")
    for path in (budgets_at, edges_at):
        discard(spark, path)
    return out


def _doc_key(seed: int) -> Column:
    return _key(F.lit(seed), F.col("whole"), F.col("row_a"), F.col("number"))


def block_of(blocks: Column, seed: int) -> Column:
    return F.pmod(_key(F.lit(seed + 1), F.col("source"), F.col("row_a"), F.col("number")), blocks).cast("int")


def hashed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, the columns in keep, and row_a, row_b: two hashes of id, source, text and what is kept. Nulls differ from all values."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(text).alias("n_tokens"), text.alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    parts = ["doc_id", "source", "__text", *[f"__keep_{c}" for c in keep if c != "text"]]
    shown = [x for c in parts for x in (F.col(c).isNull(), F.col(c))]
    return own.withColumns({"row_a": _key(F.lit(1), *shown), "row_b": _key(F.lit(2), *shown)}).drop("__text")


def numbered(own: DataFrame) -> DataFrame:
    """One row for each row of hashed(): equal ones are counted, then numbered from 0, so a group of them is never in one task."""
    groups = own.groupBy("doc_id", "source", "n_tokens", "row_a", "row_b").agg(F.count(F.lit(1)).alias("many"))
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {NUMBERS}"))))
    few, rest = parts.where(f"many <= {NUMBERS}"), parts.where(f"many > {NUMBERS}").repartition("row_a", "part")
    first = F.col("part") * NUMBERS
    return few.unionByName(rest).withColumn("number", F.explode(F.sequence(first, F.least(first + NUMBERS, "many") - 1))).drop("part")


def _with_kept(own: DataFrame, counted: DataFrame) -> DataFrame:
    """Numbered rows with the columns that are kept. Rows that repeat come from one of them; all others pass as they are."""
    again = cut(counted.where("many > 1").select("row_a", "row_b", "number"), "repeated")
    keys = again.where("number = 0").drop("number")
    once = own.join(keys, ["row_a", "row_b"], "left_anti").withColumn("number", F.lit(0).cast("long"))
    kept = [c for c in own.columns if c not in ("row_a", "row_b")]
    one = own.join(keys, ["row_a", "row_b"], "left_semi").groupBy("row_a", "row_b").agg(*[F.first(c).alias(c) for c in kept])
    return once.unionByName(one.join(again, ["row_a", "row_b"]))


def mix(docs: DataFrame, budget: int | None = None, entropy_gain: float = 0.5, max_repeats: float = 4.0, block_tokens: int = BLOCK_TOKENS, seed: int = 0, keep: tuple[str, ...] = (), slice_blocks: int = SLICE_BLOCKS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_key, doc_key and the columns in keep: one row for each draw of a document.

    budget counts tokens (None: as many as there are); more than max_repeats times
    the tokens there are is an error. Read in the order of (epoch, block_key,
    doc_key) a source's rows are its block permutations. Each row is a document of
    its own, whatever its id; equal rows are drawn one by one, and stand for each
    other. A null source is the source '', null text has no tokens; sources
    without tokens are not drawn. An empty
    table gives no rows. Other columns are not read. A plan of up to most_bytes is
    broadcast; beyond, it is joined with salted sources.
    """
    own = hashed(docs, keep)
    counted, counted_at = stored(numbered(own.drop(*[f"__keep_{c}" for c in keep])), "tokens")
    plans = plan(counted, budget, entropy_gain, max_repeats, block_tokens, seed, slice_blocks, most_bytes)
    rows = counted
    if keep:
        rows = _with_kept(own, counted)
    drawn = _by_source(rows, plans, most_bytes).withColumn("block", block_of(F.col("blocks"), seed))
    place = F.struct(_key(F.lit(seed), F.col("source"), F.col("whole"), F.col("block")).alias("edge_key"), F.col("block").alias("edge"))
    edge = F.struct("edge_key", "edge")
    partial = F.when(F.col("edge").isNull(), False).when(place == edge, F.coalesce(_doc_key(seed) <= F.col("last_key"), F.lit(False))).otherwise(place < edge)
    drawn = drawn.withColumn("copies", F.col("whole") + partial.cast("int")).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return drawn.select(
        "doc_id", "source", "n_tokens", "epoch", "block",
        _key(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")).alias("block_key"),
        _key(F.lit(seed), F.col("epoch"), F.col("row_a"), F.col("number")).alias("doc_key"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )
