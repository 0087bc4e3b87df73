"""Start codes, markers, slices and buffers of byte columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sync import first_sync  # noqa: F401
from .timeline import last_known


def marker_places(data: Column, marker: bytes) -> Column:
    """Byte positions of a marker, leftmost first, without overlaps."""
    # One character for each byte, so places in the string are places in the data.
    text = F.decode(data, "ISO-8859-1")
    parts = F.split(text, "\\Q" + marker.decode("latin1") + "\\E", -1)
    head = F.slice(parts, 1, F.size(parts) - 1)
    ends = F.aggregate(head, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-len(marker)).cast("bigint")) + len(marker) + F.length(x)))
    return F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<bigint>"))


def start_codes(df: DataFrame, data: str, keys: list[str]) -> DataFrame:
    """keys, at, code: every 00 00 01 with the byte after it."""
    found = df.select(*keys, F.col(data).alias("__data"), F.explode(marker_places(F.col(data), b"\x00\x00\x01")).alias("at"))
    return found.select(*keys, "at", F.conv(F.hex(F.substring("__data", F.col("at").cast("int") + 4, F.lit(1))), 16, 10).cast("bigint").alias("code"))


def _ordered(order: str, value: str) -> Column:
    """A group's values in order. A field of the array is taken, as a lambda around the sort would keep it from being compiled."""
    return F.sort_array(F.collect_list(F.struct(order, value))).getField(value)


def slices(df: DataFrame, keys: list[str], order: str, opens: Column, value: str) -> DataFrame:
    """Rows between markers as one: keys, picture number, count and values in order. Rows before the first marker go."""
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("picture", F.sum(opens.cast("bigint")).over(sofar)).where("picture > 0")
    lists = _ordered(order, value)
    return marked.groupBy(*keys, "picture").agg(F.count(F.lit(1)).alias("slices"), lists.alias("offsets"))


def slice_geometry(df: DataFrame, keys: list[str], order: str, offset: str, mb_width: int) -> DataFrame:
    """Bits up to the next slice, and macroblocks before each slice."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("bits", ((F.lead(offset).over(w) - F.col(offset)) * 8).cast("bigint")).withColumn("mb_start", (F.row_number().over(w) - 1).cast("bigint") * mb_width)


def coalesced(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The buffers of a sample as one string or binary, in order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("buffers"), F.array_join(_ordered(order, value), "").alias("joined"))


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value is not that before it; the first is."""
    before, after = column[:-1], column[1:]
    other = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(pc.is_null(before), pc.is_null(after)))
    return np.concatenate([[True], other.to_numpy(zero_copy_only=False).astype(bool)])


def join_task(keys: list[str]):
    """Values of sorted_runs as one. Those of a batch lie one after the other, so a run is a slice; the last run of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            found, values = batch.select(keys), batch.column("__value").cast(pa.large_binary())
            starts = np.flatnonzero(np.logical_or.reduce([_differs(c) for c in found.columns]))
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            data = memoryview(values.buffers()[2] or b"")
            places = [*offsets[starts].tolist(), int(offsets[-1])]
            if own is not None and own.equals(found.slice(0, 1)):
                first = 1
                held.append(bytes(data[places[0] : places[1]]))
            else:
                first = 0
            if own is not None and (not first or len(starts) > 1):
                yield own.append_column("joined", pa.array([b"".join(held)], pa.binary()))
                own, held = None, []
            last = len(starts) - 1
            if last > first:
                whole = pa.array([bytes(data[a:b]) for a, b in zip(places[first:last], places[first + 1 : last + 1], strict=True)], pa.binary())
                yield found.take(pa.array(starts[first:last])).append_column("joined", whole)
            if own is None:
                own, held = found.slice(int(starts[last]), 1), [bytes(data[places[last] : places[last + 1]])]
        if own is not None:
            yield own.append_column("joined", pa.array([b"".join(held)], pa.binary()))

    return run


def sorted_runs(df: DataFrame, keys: list[str], order: list[str], value: Column, tasks: int | None = None) -> DataFrame:
    """keys, __value: a value of each row, those of a key one after the other in order, dealt to so many tasks.

    Rows are sorted before the value is worked out, so only its columns are shuffled.
    Spark's own number of tasks goes by the shuffled bytes, of which large values show nothing.
    """
    dealt = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).select(*keys, value.alias("__value"))


def joined_runs(df: DataFrame, keys: list[str], order: list[str], value: Column, tasks: int | None = None) -> DataFrame:
    """keys, joined: a binary value of each row in order, as one binary. Keys may be null; null values add nothing.

    No group is collected: a task holds one joined value and a batch.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return sorted_runs(df, keys, order, value, tasks).mapInArrow(join_task(keys), f"{kinds}, joined binary")


def chunk_states(codes: DataFrame, keys: list[str], order: str, code: str = "code") -> DataFrame:
    """Video start codes with their unit and whether they begin a new picture's access unit.

    Units: slice (1 to 175), picture (0), sequence (179), extension (181), user (178),
    end (183), gop (184), else other. A sequence, group or picture unit begins an
    access unit if the one before it in its stream was a slice or there was none.
    The order is a BIGINT that is unique in a stream.
    """
    c = F.col(code)
    unit = F.when(c == 0, "picture").when(c.between(1, 0xAF), "slice").when(c == 0xB3, "sequence").when(c == 0xB5, "extension").when(c == 0xB2, "user").when(c == 0xB7, "end").when(c == 0xB8, "gop").otherwise("other")
    begins = F.col("unit").isin("sequence", "gop", "picture") & (F.col("__before").isNull() | (F.col("__before") == "slice"))
    known = last_known(codes.withColumn("unit", unit), keys, order, F.col("unit"), "__before", before=True)
    return known.withColumn("begins", F.coalesce(begins, F.lit(False))).drop("__before")


def marker_count(data: Column, marker: bytes) -> Column:
    """How often a marker stands in bytes, without overlaps."""
    return F.size(marker_places(data, marker)).cast("bigint")
