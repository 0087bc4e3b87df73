"""Clock-driven release: samples wait until event time reaches their presentation time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Release(StatefulProcessor):
    """State of a stream: the samples that wait. A timer at a sample's time lets it and all earlier ones go; none is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pts_ms bigint, seq bigint")

    def _go(self, key, now: int) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if ready:
            yield pd.DataFrame({"stream_id": [key[0]] * len(ready), "seq": [x[1] for x in ready], "pts_ms": [x[0] for x in ready], "late_ms": [now - x[0] for x in ready]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for row in pd.concat(list(rows)).itertuples():
            self.waiting.appendValue((int(row.pts_ms), int(row.seq)))
            if row.pts_ms > now:
                self.handle.registerTimer(int(row.pts_ms))
        yield from self._go(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def released(samples: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """stream_id, seq, pts_ms, late_ms of a stream of samples(stream_id, seq, ts), in the order of their time.

    ts is the time at which a sample is due. The clock is the watermark, which
    trails the latest ts by `delay`. late_ms is how far the clock was past the
    sample when it went.
    """
    timed = samples.withWatermark("ts", delay).select("stream_id", "seq", "ts", F.unix_millis("ts").alias("pts_ms"))
    return timed.groupBy("stream_id").transformWithStateInPandas(Release(), "stream_id string, seq bigint, pts_ms bigint, late_ms bigint", "Append", "EventTime")
