"""Order and time operators over sample tables.

Numbering, running sums and last known values that would need one global order
are done in two passes: over blocks of the order column, then inside a block.
Blocks have a fixed width of the order column, so no task holds more than one
block of one key, however long a stream is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock

BLOCK = 100_000


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "seq", width: int = BLOCK) -> DataFrame:
    """df with the place (from 0) of each row in its stream; `order` is a BIGINT that is unique in a stream."""
    return prefix_sum(df, keys, order, F.lit(1).cast("bigint"), name, width)


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BLOCK) -> DataFrame:
    """df with the sum of `value` over the rows before each row of its stream (0 for the first)."""
    return prefix_sums(df, keys, order, {name: value}, width)


def prefix_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = BLOCK) -> DataFrame:
    """prefix_sum of several values at once.

    A row's stream and block are one struct, which is never null, so the window
    and the join of the blocks' sums take the same shuffle and sort.
    """
    block = F.floor(F.col(order) / F.lit(float(width))).cast("bigint")
    marked = df.withColumns({"__in": F.struct(*keys, block.alias("__block"))} | {f"__value_{i}": v.cast("bigint") for i, v in enumerate(values.values())})
    places = range(len(values))
    totals = marked.groupBy("__in").agg(*[F.sum(f"__value_{i}").alias(f"__total_{i}") for i in places])
    before = Window.partitionBy(*[F.col("__in").getField(k) for k in keys]).orderBy(F.col("__in").getField("__block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__in").alias("__of"), *[F.coalesce(F.sum(f"__total_{i}").over(before), F.lit(0)).alias(f"__base_{i}") for i in places])
    inside = Window.partitionBy("__in").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumns({f"__inside_{i}": F.coalesce(F.sum(f"__value_{i}").over(inside), F.lit(0)) for i in places})
    out = out.join(totals, out["__in"] == totals["__of"])
    return out.select(*[c for c in df.columns if not c.startswith("__") or c in keys], *[(F.col(f"__inside_{i}") + F.col(f"__base_{i}")).cast("bigint").alias(n) for i, n in enumerate(values)])


def last_known(df: DataFrame, keys: list[str], order: str, value: Column, name: str, before: bool = False, width: int = BLOCK) -> DataFrame:
    """df with the last value that is not null at each row or earlier (`before`: earlier only) in its stream.

    Inside a block by a window; the last value of earlier blocks comes from a
    window over one row for each block.
    """
    df = df.withColumn("__block", F.floor(F.col(order) / F.lit(float(width))).cast("bigint")).withColumn("__value", value)
    ends = df.groupBy(*keys, "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__b"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    out = df.withColumn("__inside", F.last("__value", ignorenulls=True).over(inside))
    same = [out[k].eqNullSafe(ends[f"__k_{k}"]) for k in keys] + [out["__block"].eqNullSafe(ends["__b"])]
    out = out.join(ends, same)
    return out.select(*[c for c in df.columns if c not in ("__block", "__value")], F.coalesce("__inside", "__carried").alias(name))


def gap_fill(df: DataFrame, keys: list[str], order: str, pts: str, step: Column, name: str = "filled", width: int = BLOCK) -> DataFrame:
    """Missing times count on from the last known one by `step`; null before the first known one."""
    placed = numbered(df, keys, order, "__place", width)
    anchor = F.when(F.col(pts).isNotNull(), F.struct(F.col(pts).alias("pts"), F.col("__place").alias("place")))
    placed = last_known(placed, keys, order, anchor, "__anchor", width=width)
    return placed.withColumn(name, (F.col("__anchor.pts") + (F.col("__place") - F.col("__anchor.place")) * step).cast("bigint")).drop("__place", "__anchor")


def lag_duration(df: DataFrame, keys: list[str], order: str, pts: str, name: str = "dur_hns", width: int = BLOCK) -> DataFrame:
    """Time since the sample before, the time itself for a stream's first. Without keys: across all streams."""
    out = last_known(df, keys, order, F.struct(F.col(pts).alias("pts")), "__earlier", before=True, width=width)
    return out.withColumn(name, (F.col(pts) - F.coalesce("__earlier.pts", F.lit(0))).cast("bigint")).drop("__earlier")


def unwrapped(df: DataFrame, keys: list[str], order: str, pts: str, name: str = "pts_long") -> DataFrame:
    """A 33-bit clock without its wraps."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__wrap", clock.unwrapped(F.col(pts), F.lag(pts).over(w)))
    return df.withColumn(name, F.col(pts) + F.sum("__wrap").over(w.rowsBetween(Window.unboundedPreceding, 0)) * (1 << 33)).drop("__wrap")


def display_order(df: DataFrame, gop: list[str], decode: str, ptype: str, temporal: str, name: str = "display_seq") -> DataFrame:
    """Place of each picture in display order: by temporal reference, anew after each I picture in decode order."""
    sofar = Window.partitionBy(*gop).orderBy(decode).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__group", F.sum((F.col(ptype) == "I").cast("int")).over(sofar))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*gop).orderBy("__group", temporal, decode)).cast("bigint") - 1).drop("__group")


def references(df: DataFrame, gop: list[str], decode: str, ptype: str, ident: str) -> DataFrame:
    """forward and backward reference of each picture.

    I has none, P the last picture that is not B, B that one backward and the one before it forward.
    """
    w = Window.partitionBy(*gop).orderBy(decode)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.col(ptype) != "B"
    last = F.last(F.when(anchor, F.col(ident)), ignorenulls=True).over(before)
    df = df.withColumn("__last", last)
    # The anchor before the last one is what the last anchor itself saw as its last.
    second = F.last(F.when(anchor, F.struct(F.col("__last").alias("x"))), ignorenulls=True).over(before)
    df = df.withColumn("__second", second)
    forward = F.when(F.col(ptype) == "P", F.col("__last")).when(F.col(ptype) == "B", F.col("__second.x"))
    return df.withColumn("forward", forward).withColumn("backward", F.when(F.col(ptype) == "B", F.col("__last"))).drop("__last", "__second")


def after_first_key(df: DataFrame, keys: list[str], order: str, key: Column) -> DataFrame:
    """Rows from each stream's first key picture on."""
    first = df.withColumn("__key", key).where("__key").groupBy(*keys).agg(F.min(order).alias("__first"))
    first = first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first")
    return df.join(first, [df[k].eqNullSafe(first[f"__k_{k}"]) for k in keys] + [df[order] >= first["__first"]]).select(*df.columns)


def release(pts: Column, now: Column, frame: Column | int) -> Column:
    """present when more than a quarter frame late, wait when more than three quarters early, else poll; nothing is dropped."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    early = pts - now
    return F.when(early * 4 < -frame, "present").when(early * 4 > frame * 3, "wait").otherwise("poll")


def stream_span(df: DataFrame, keys: list[str], order: str, pts: str) -> DataFrame:
    """first and last time and their difference for each stream, by order rather than by time."""
    known = df.where(F.col(pts).isNotNull())
    out = known.groupBy(*keys).agg(F.min_by(pts, order).alias("first_pts"), F.max_by(pts, order).alias("last_pts"))
    return out.withColumn("dur_hns", F.col("last_pts") - F.col("first_pts"))


def intervals_between(df: DataFrame, keys: list[str], order: str, opens: Column, closes: Column, width: int = BLOCK) -> DataFrame:
    """Rows while the last state change before or at them opened the stream."""
    state = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    return last_known(df, keys, order, state, "__open", width=width).where("__open").drop("__open")


def preroll_ready(place: Column, needed: int) -> Column:
    """Whether a stream has `needed` samples by the one at this place, which counts from 0."""
    return place + 1 >= needed


def clean_point(ptype: Column) -> Column:
    """Whether decoding may begin at a picture."""
    return ptype == "I"
