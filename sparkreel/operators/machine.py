"""State machines over logs of any length, one key in many tasks.

A block of events is a map from the state before it to the state after it. Maps
compose, so blocks are reduced side by side, then the state at each block's start
follows from the maps before it, over groups of blocks first, and last each block
is run from its start. A task takes the blocks or groups that it has one after the
other in batches of rows, so that short blocks cost no more than their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import BLOCK

#: Blocks whose maps one task composes.
GROUP = 1_000


@dataclass(frozen=True)
class Machine:
    """moves: (state, event) to the next state. Other events lead to otherwise[state], or leave the state, and are not ok."""

    start: str
    moves: dict[tuple[str, str], str]
    otherwise: dict[str, str] = field(default_factory=dict)

    def states(self) -> list[str]:
        pairs = [(s, to) for (s, _), to in self.moves.items()] + list(self.otherwise.items())
        return sorted({self.start, *(x for p in pairs for x in p)})

    def tables(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Numbers of events, and by event and state the next state and whether the move is there; the last row is for all other events."""
        states = self.states()
        events = {e: i for i, e in enumerate(sorted({e for _, e in self.moves}))}
        rest = [states.index(self.otherwise.get(s, s)) for s in states]
        to, ok = np.tile(np.array(rest, np.int32), (len(events) + 1, 1)), np.zeros((len(events) + 1, len(states)), bool)
        for (state, event), after in self.moves.items():
            to[events[event], states.index(state)], ok[events[event], states.index(state)] = states.index(after), True
        return events, to, ok


def scanned(maps: np.ndarray, first: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """For each map the one that does all of its run up to it. first: where runs begin; carried: the map of the run that rows before the first start go on with."""
    n = len(maps)
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    out, step = maps.astype(np.int64), 1
    while n and step <= place.max():
        late = np.flatnonzero(place >= step)
        out[late] = np.take_along_axis(out[late], out[late - step], axis=1)
        step *= 2
    going = n if not first.any() else int(np.argmax(first))
    out[:going] = out[:going][:, carried]
    return out


def _codes(events: dict[str, int], column: pa.Array) -> np.ndarray:
    found = pc.index_in(column.cast(pa.string()), value_set=pa.array(list(events), pa.string()))
    return pc.fill_null(found, len(events)).to_numpy(zero_copy_only=False)


def _listed(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("map").to_pylist(), np.int64)


def _runs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows in the order of their runs, marked where a run begins and where it ends. A task takes many runs, batch after batch, however short they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__first", F.row_number().over(w) == 1).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    return marked.sortWithinPartitions(*keys, order)


def _walked(batches: Iterator[pa.RecordBatch], states: int, maps: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, where runs begin, maps of runs before each row, maps of runs up to each row)"""
    carried = np.arange(states)
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column("__first").to_numpy(zero_copy_only=False).astype(bool)
        after = scanned(maps(batch), first, carried)
        before = np.concatenate([carried[None], after[:-1]])
        carried = after[-1]
        yield batch, first, before, after


def _mapped(keys: list[str], states: int, maps: Callable[[pa.RecordBatch], np.ndarray]):
    """Each run's composed map with its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, after in _walked(batches, states, maps):
            last = batch.column("__last")
            out = pa.array(after[last.to_numpy(zero_copy_only=False).astype(bool)].tolist(), pa.list_(pa.int32()))
            yield batch.select(keys).filter(last).append_column("map", out)

    return run


def _begun(kept: list[str], states: int):
    """The state at the start of each map of runs that begin with the state in `__entry`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, before, _ in _walked(batches, states, _listed):
            entry = batch.column("__entry").to_numpy()
            state = np.where(first, entry, before[np.arange(len(entry)), entry])
            yield batch.select(kept).append_column("__entry", pa.array(state, pa.int32()))

    return run


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _joined(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `__entry`, by keys that may be null."""
    named = entries.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], "__entry")
    return rows.join(named, [rows[k].eqNullSafe(named[f"__k_{i}"]) for i, k in enumerate(keys)]).drop(*[f"__k_{i}" for i in range(len(keys))])


def run(log: DataFrame, keys: list[str], order: str, event: str, machine: Machine, width: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The log with from_state, to_state and ok for each event, by a BIGINT order that is unique in a key.

    Blocks are `width` units of the order wide. A null or unknown event is not ok.
    Keys may be null. An empty log gives no rows.
    """
    events, to, ok = machine.tables()
    states = machine.states()
    rows = log.withColumn("__block", F.floor(F.col(order) / F.lit(float(width))).cast("bigint"))
    slim = rows.select(*keys, "__block", F.col(order).alias("__order"), F.col(event).cast("string").alias("__event"))
    kinds, n = _fields(slim, [*keys, "__block"]), len(states)
    blocks = _runs(slim, [*keys, "__block"], "__order").mapInArrow(_mapped([*keys, "__block"], n, lambda b: to[_codes(events, b.column("__event"))]), f"{kinds}, map array<int>")
    blocks = blocks.withColumn("__group", F.floor(F.col("__block") / F.lit(float(group))).cast("bigint"))
    grouped = _fields(blocks, [*keys, "__group"])
    groups = _runs(blocks, [*keys, "__group"], "__block").mapInArrow(_mapped([*keys, "__group"], n, _listed), f"{grouped}, map array<int>")
    first = _runs(groups.withColumn("__entry", F.lit(states.index(machine.start))), keys, "__group").mapInArrow(_begun([*keys, "__group"], n), f"{grouped}, __entry int")
    placed = _joined(blocks, first, [*keys, "__group"])
    entries = _runs(placed, [*keys, "__group"], "__block").mapInArrow(_begun([*keys, "__block"], n), f"{kinds}, __entry int")
    names, labels = log.columns, pa.array(states, pa.string())

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, before, after in _walked(batches, n, lambda b: to[_codes(events, b.column(event))]):
            entry, code, each = batch.column("__entry").to_numpy(), _codes(events, batch.column(event)), np.arange(batch.num_rows)
            state = np.where(first, entry, before[each, entry])
            moved = [labels.take(pa.array(s)) for s in (state, after[each, entry])]
            yield batch.select(names).append_column("from_state", moved[0]).append_column("to_state", moved[1]).append_column("ok", pa.array(ok[code, state], pa.bool_()))

    whole = _runs(_joined(rows, entries, [*keys, "__block"]), [*keys, "__block"], order)
    return whole.mapInArrow(stepped, f"{_fields(log, names)}, from_state string, to_state string, ok boolean")


#: A session is played, paused and stopped only where that makes sense; an error of any call closes it.
SESSION = Machine(
    "ready",
    {("ready", "play"): "started", ("paused", "play"): "started", ("stopped", "play"): "started", ("started", "pause"): "paused", ("started", "stop"): "stopped", ("paused", "stop"): "stopped",
     ("ready", "close"): "closed", ("started", "close"): "closed", ("paused", "close"): "closed", ("stopped", "close"): "closed", ("closed", "open"): "ready"},
)

#: Units of a video stream. Before a sequence header nothing counts; a unit out of place loses the picture until the next header.
_HEADS = ("sequence", "gop", "picture", "slice", "lost", "ended")
VIDEO = Machine(
    "seek",
    {(s, "sequence"): "sequence" for s in ("seek", *_HEADS)}
    | {(s, "picture"): "picture" for s in ("sequence", "gop", "slice", "lost", "ended")}
    | {(s, "gop"): "gop" for s in ("sequence", "slice", "lost", "ended")}
    | {(s, "end"): "ended" for s in ("slice", "lost", "ended")}
    | {("picture", "slice"): "slice", ("slice", "slice"): "slice"}
    | {(s, "extension"): s for s in ("sequence", "picture")}
    | {(s, "user"): s for s in ("sequence", "gop", "picture")},
    {s: "lost" for s in _HEADS if s != "ended"},
)
