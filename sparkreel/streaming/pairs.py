"""Two streams zipped by position, and epochs of which only the last counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Samples of one side that may wait in a key, and keys that positions are dealt to.
WAITING = 100_000
KEYS = 64
#: Places of a key whose samples wait in one entry of the state.
PAGE = 512


class Zip(StatefulProcessor):
    """Samples that wait for the other side's sample at their place, by pages of places: a page is read and written once a batch. A side that runs too far ahead is an error, as no sample may go."""

    def __init__(self, most: int, page: int):
        self.most, self.page = most, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "page bigint", "seqs array<bigint>, firsts array<boolean>, times array<bigint>, payloads array<bigint>")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        come: dict[int, list[tuple[int, bool, int | None, int | None]]] = {}
        for frame in rows:
            times, payloads = ([None if v is None or pd.isna(v) else int(v) for v in frame[c]] for c in ("pts_hns", "payload"))
            for seq, first, pts, payload in zip(frame["seq"].astype("int64").tolist(), frame["first"].astype(bool).tolist(), times, payloads, strict=True):
                come.setdefault(seq // self.page, []).append((seq, first, pts, payload))
        for page, samples in come.items():
            known = self.waiting.containsKey((page,))
            held = {(seq, first): value for seq, first, *value in zip(*self.waiting.getValue((page,)), strict=True)} if known else {}
            n -= len(held)
            for seq, first, *value in samples:
                met = held.pop((seq, not first), None)
                if met is None:
                    held[seq, first] = value
                else:
                    a, b = (value, met) if first else (met, value)
                    out.append((seq, a[0], a[1], b[1]))
            n += len(held)
            if held:
                self.waiting.updateValue((page,), tuple(map(list, zip(*((*k, *v) for k, v in held.items()), strict=True))))
            elif known:
                self.waiting.removeKey((page,))
        if n > self.most:
            raise ValueError(f"{n} samples wait for the other stream")
        self.count.update((n,))
        if out:
            columns = list(zip(*out, strict=True))
            yield pd.DataFrame({name: pd.array(c, "Int64") for name, c in zip(("seq", "pts_hns", "a", "b"), columns, strict=True)})

    def close(self) -> None:
        pass


def zipped(samples: DataFrame, keys: int = KEYS, most: int = WAITING) -> DataFrame:
    """seq, pts_hns, a, b of samples(seq, first, pts_hns, payload): the first stream's sample and time with the other's at the same place.

    Any order of arrival gives what operators.multi.zip_streams gives of the two
    tables; what one stream has beyond the other's end waits and is never given.
    A place must be there once in each stream. Places are dealt to `keys` keys, so
    the state is spread over tasks; PAGE places of a key have one entry of its state.
    """
    dealt = samples.select(F.pmod(F.col("seq"), F.lit(keys)).alias("deal"), "seq", "first", "pts_hns", F.col("payload").cast("bigint").alias("payload"))
    return dealt.groupBy("deal").transformWithStateInPandas(Zip(most, keys * PAGE), "seq bigint, pts_hns bigint, a bigint, b bigint", "Append", "None")


class Epochs(StatefulProcessor):
    """The epoch of a stream; rows of earlier ones are results of requests that were given up."""

    def __init__(self, key: str, columns: list[str]):
        self.key, self.columns = key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        now = int(max(frame["epoch"].max(), self.epoch.get()[0] if self.epoch.exists() else frame["epoch"].max()))
        self.epoch.update((now,))
        kept = frame[frame["epoch"] == now]
        if len(kept):
            yield kept[self.columns]

    def close(self) -> None:
        pass


def current(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a stream, with an epoch that is not null, unless a later epoch of their key has been seen by then.

    A key's state is one number, whatever waits or comes late. Rows that were
    given before their epoch ended are stale later: operators.routing.latest_epoch
    of the output is that of the whole input.
    """
    return rows.groupBy(key).transformWithStateInPandas(Epochs(key, rows.columns), rows.schema, "Append", "None")
