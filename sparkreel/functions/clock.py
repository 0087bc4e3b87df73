"""Time arithmetic in ticks of 100 ns ("hns"), all in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 10_000_000


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero; null for a zero divisor."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def from_90k(ticks: Column) -> Column:
    return div(ticks.cast("bigint") * 10_000, 90)


def from_ms(ms: Column, composition: Column | int = 0) -> Column:
    composition = F.lit(composition) if isinstance(composition, int) else composition
    return (ms.cast("bigint") + composition.cast("bigint")) * 10_000


def of_bytes(n: Column, bytes_per_second: Column | int) -> Column:
    """Duration of n bytes at a byte rate."""
    return div(n.cast("bigint") * SECOND, bytes_per_second)


def of_frame(numerator: Column, denominator: Column) -> Column:
    """Average time of a frame at a rate of numerator / denominator."""
    return div(denominator.cast("bigint") * SECOND, numerator)


def of_file(size: Column, bits_per_second: Column) -> Column:
    """Estimated duration of a file of constant bit rate; multiplies before it divides."""
    return div(size.cast("bigint") * 8 * SECOND, bits_per_second)


def spoken(hns: Column) -> Column:
    """hh:mm:ss.mmm"""
    ms = div(hns, 10_000)
    part = lambda unit, n: F.lpad((div(ms, unit) % n).cast("string"), 2, "0")
    hours = div(ms, 3_600_000)
    hours = F.lpad(hours.cast("string"), F.greatest(F.lit(2), F.length(hours.cast("string"))), F.lit("0"))
    return F.concat(hours, F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def unwrapped(pts: Column, before: Column) -> Column:
    """1 where a 33-bit clock has wrapped since the sample before."""
    return F.coalesce((before - pts > (1 << 32)).cast("bigint"), F.lit(0).cast("bigint"))
