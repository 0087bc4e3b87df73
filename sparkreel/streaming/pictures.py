"""Pictures in display order and their times, batch and streaming."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import timeline
from ..sinks.files import scratch

#: Pictures held back at most before the first is released.
WINDOW = 20
#: Keys that streams are dealt to.
KEYS = 4096


class Reorder(StatefulProcessor):
    """Holds pictures until their group is over, or until `window` later ones have come, then lets the lowest go. Many streams share a key and its state."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "streams array<string>, groups array<bigint>, shown array<bigint>")
        self.held = handle.getValueState("held", "streams array<string>, groups array<bigint>, refs array<bigint>, seqs array<bigint>, kinds array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        places = {s: (g, n) for s, g, n in zip(*self.place.get(), strict=True)} if self.place.exists() else {}
        waiting: dict[str | None, list[tuple]] = {}
        for stream, *picture in zip(*self.held.get(), strict=True) if self.held.exists() else ():
            waiting.setdefault(stream, []).append(tuple(picture))
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("decode_seq").itertuples():
            stream = None if pd.isna(row.stream_id) else row.stream_id
            (group, shown), held = places.get(stream, (0, 0)), waiting.setdefault(stream, [])
            group += row.ptype == "I"
            bisect.insort(held, (group, int(row.temporal_ref), int(row.decode_seq), row.ptype))
            gone = 0
            while gone < len(held) and (held[gone][0] < group or len(held) - gone > self.window):
                out.append((stream, held[gone][2], held[gone][3], shown + gone))
                gone += 1
            del held[:gone]
            places[stream] = group, shown + gone
        self.place.update((list(places), [g for g, _ in places.values()], [n for _, n in places.values()]))
        left = [(s, *x) for s, held in waiting.items() for x in held]
        self.held.update(tuple(map(list, zip(*left, strict=True)))) if left else self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "decode_seq", "ptype", "display_seq"])

    def close(self) -> None:
        pass


def reordered(pictures: DataFrame, window: int = WINDOW, keys: int = KEYS) -> DataFrame:
    """stream_id, decode_seq, ptype, display_seq of a stream of pictures; what is held at the end comes with the next I picture.

    End a stream with an I picture to let all go; tables are better ordered with
    operators.timeline.display_order, which needs no state. Streams are dealt to
    `keys` keys, whose states are read and written as one.
    """
    dealt = pictures.select(F.pmod(F.xxhash64("stream_id"), F.lit(keys)).alias("deal"), "stream_id", "decode_seq", "temporal_ref", "ptype")
    return dealt.groupBy("deal").transformWithStateInPandas(Reorder(window), "stream_id string, decode_seq bigint, ptype string, display_seq bigint", "Append", "None")


def take_times(kinds: list[str], stamps: list[tuple[int | None, int | None] | None]) -> list[int | None]:
    """Times of pictures in decode order, taken from a queue that packets fill.

    stamps[i] is (pts, dts) of the packet that came just before picture i, or None.
    A B picture leaves the front of the queue alone if its dts is known and is not
    its pts; every other picture takes it.
    """
    queue: list[tuple[int | None, int | None]] = []
    out: list[int | None] = []
    for kind, stamp in zip(kinds, stamps, strict=True):
        if stamp is not None:
            queue.append(stamp)
        if not queue or (kind == "B" and queue[0][1] is not None and queue[0][0] != queue[0][1]):
            out.append(None)
        else:
            out.append(queue.pop(0)[0])
    return out


#: Pictures of a stream that one task walks at most, where blocks are smaller.
RUN = 100_000
_WALK = "stream_id string, run bigint, kind int, place bigint, decode_seq bigint, ptype string, j bigint, pts bigint, late boolean"
_TIMES = "stream_id string, run bigint, decode_seq bigint, ptype string, time bigint"
#: Rows of a run in the order that they are walked in: how many packets were taken before, packets that wait since then, pictures.
_BEGIN, _HELD, _PICTURE = 0, 1, 2


def _walk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pictures of sorted runs with their times. The queue is carried from batch to batch; a run's first row empties it."""
    first, queue = 0, deque()
    for batch in batches:
        times, pts, kinds = [], batch.column("pts"), batch.column("kind").to_numpy()
        stamped, bidirectional = pc.is_valid(pts), pc.fill_null(pc.equal(batch.column("ptype"), "B"), False)
        flags = [x.to_numpy(zero_copy_only=False).tolist() for x in (stamped, bidirectional, pc.fill_null(batch.column("late"), False))]
        numbers = [pc.fill_null(x, 0).to_numpy().tolist() for x in (batch.column("j"), pts)]
        for kind, j, stamp, packet, b, late in zip(kinds.tolist(), *numbers, *flags, strict=True):
            if kind == _BEGIN:
                first = j
                queue.clear()
                continue
            if packet and j >= first:
                queue.append((stamp, late))
            if kind == _PICTURE:
                times.append(None if not queue or (b and queue[0][1]) else queue.popleft()[0])
        shown = batch.filter(pc.equal(batch.column("kind"), _PICTURE))
        yield shown.select(["stream_id", "run", "decode_seq", "ptype"]).append_column("time", pa.array(times, pa.int64()))


def with_times(pictures: DataFrame, width: int = 10_000, group: int | None = None) -> DataFrame:
    """pictures(stream_id, decode_seq, ptype, pts, dts) with time: the packet times as decoders attach them, by the rule of take_times.

    pts null: no packet came before the picture; decode_seq is a BIGINT that is
    unique in a stream. A stream is cut into blocks of `width` pictures, and `group`
    blocks (as many as have RUN pictures) are a run, which a task walks in order
    among many others. All that a run needs of those before it is how many packets
    they took, and those that wait since then. That is known from running minima if
    no B picture leaves a packet alone, and is the sum of what earlier runs took in
    any case: runs are walked side by side from where the last round's sums put
    them, until the sums stand still. Each round settles one more run of a stream at
    least. A stream of one run is settled by the first. A task holds the packets that
    wait, which are at most two runs' at a time.
    """
    size = width * (group or max(RUN // width, 1))
    own = pictures.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("decode_seq").cast("bigint").alias("decode_seq"), "ptype", F.col("pts").cast("bigint").alias("pts"), F.col("dts").cast("bigint").alias("dts"))
    placed = timeline.prefix_sums(own, ["stream_id"], "decode_seq", {"place": F.lit(1), "j": F.col("pts").isNotNull().cast("bigint")})
    run = F.floor(F.col("place") / F.lit(float(size))).cast("bigint")
    placed = _stored(placed.select("stream_id", run.alias("run"), "place", "decode_seq", "ptype", "j", "pts", F.coalesce(F.col("dts") != F.col("pts"), F.lit(False)).alias("late")), "pictures")

    # If every picture takes a packet when there is one: taken up to a place = place + min(1, least of packets so far - place).
    earlier = Window.partitionBy("stream_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("j") + F.col("pts").isNotNull().cast("bigint") - F.col("place")
    runs = placed.groupBy("stream_id", "run").agg(F.min(sofar).alias("least"), F.min("j").alias("come"))
    first = F.coalesce(F.col("run") * size - 1 + F.least(F.min("least").over(earlier), F.lit(1)), F.lit(0)).cast("bigint")
    starts = _stored(runs.select("stream_id", "run", "come", first.alias("first"), F.lit(False).alias("ever"), F.lit(True).alias("moved")), "starts")

    def same(a: DataFrame, b: DataFrame, column: str = "run") -> Column:
        return a["stream_id"].eqNullSafe(b["__stream"]) & (a[column] == b[f"__{column}"])

    def keyed(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(F.col("stream_id").alias("__stream"), F.col("run").alias("__run"), *columns)

    def walked(todo: DataFrame, rows: DataFrame) -> DataFrame:
        """Times of the rows, which are the pictures of the runs to do."""
        def row(kind: int, *columns: str, **values: Column) -> list[Column]:
            values |= {c: F.col(c) for c in columns} | {"kind": F.lit(kind)}
            return [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in _WALK.split(", "))]

        parts = [todo.select(*row(_BEGIN, "stream_id", "run", j=F.col("first"))), rows.select(*row(_PICTURE, *placed.columns))]
        behind = todo.where("first < come")
        if not behind.isEmpty():
            near = behind.select(F.col("stream_id").alias("__stream"), F.col("run").alias("__run"), "first", "come", F.explode(F.array(*[F.floor(F.col("first") / F.lit(float(size))).cast("bigint") + n for n in (0, 1)])).alias("__part"))
            items = placed.where("pts is not null").select("stream_id", "j", "pts", "late", F.floor(F.col("j") / F.lit(float(size))).cast("bigint").alias("part"))
            held = items.join(near, same(items, near, "part") & (items["j"] >= near["first"]) & (items["j"] < near["come"]))
            parts.append(held.select(*row(_HELD, "stream_id", "j", "pts", "late", run=F.col("__run"), place=F.col("j"))))
        whole = reduce(DataFrame.unionByName, parts).repartition("stream_id", "run").sortWithinPartitions("stream_id", "run", "kind", "place")
        return whole.mapInArrow(_walk_task, _TIMES)

    def of(todo: DataFrame) -> DataFrame:
        named = keyed(todo)
        return placed.join(named, same(placed, named), "left_semi")

    names = [x.split()[0] for x in _TIMES.split(", ") if not x.startswith("run")]
    times = _stored(walked(starts, placed), "times")
    found, taken = times, F.lit(None).cast("bigint")
    while True:
        # A time is taken with its packet.
        counts = keyed(found.groupBy("stream_id", "run").agg(F.count("time").alias("__taken")), "__taken")
        known = starts.join(counts, same(starts, counts), "left").select("stream_id", "run", "come", "first", "ever", F.coalesce("__taken", taken).alias("taken"))
        sums = known.withColumn("due", F.coalesce(F.sum("taken").over(earlier), F.lit(0)).cast("bigint"))
        moved = F.col("due") != F.col("first")
        starts = _stored(sums.select("stream_id", "run", "come", F.col("due").alias("first"), (F.col("ever") | moved).alias("ever"), moved.alias("moved"), "taken"), "starts")
        todo, taken = starts.where("moved"), F.col("taken")
        if todo.isEmpty():
            break
        found = walked(todo, of(todo))
    again = starts.where("ever")
    if again.isEmpty():
        return times.select(*names)
    named = keyed(again)
    return times.join(named, same(times, named), "left_anti").select(*names).unionByName(walked(again, of(again)).select(*names))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
