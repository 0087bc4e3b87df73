"""WAV files of PCM streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import le


def header(n: Column, channels: int, rate: int, bits: int) -> Column:
    """The 44 bytes before n bytes of PCM data."""
    block = channels * bits // 8
    fixed = [F.lit(16), F.lit(1), F.lit(channels), F.lit(rate), F.lit(rate * block), F.lit(block), F.lit(bits)]
    return F.concat(F.lit("RIFF").cast("binary"), le(n + 36, 4), F.lit("WAVEfmt ").cast("binary"), *[le(x, w) for x, w in zip(fixed, (4, 2, 2, 4, 4, 2, 2), strict=True)], F.lit("data").cast("binary"), le(n, 4))


def parts(samples: DataFrame, keys: list[str], order: str, payload: str, channels: int, rate: int, bits: int) -> DataFrame:
    """keys, order, bytes: a header row (order null) and the payloads of each file; in order they are the file.

    The header needs the length of all data, a sum; payloads never meet in one task.
    """
    totals = samples.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length(payload).cast("bigint")), F.lit(0)).alias("n"))
    head = totals.select(*keys, F.lit(None).cast(samples.schema[order].dataType).alias(order), header(F.col("n"), channels, rate, bits).alias("bytes"))
    return head.unionByName(samples.select(*keys, order, F.col(payload).alias("bytes")))
