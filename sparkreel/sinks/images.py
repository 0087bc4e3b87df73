"""Bitmap files as binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le(value: Column, n: int) -> Column:
    """A number as n little-endian bytes."""
    text = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.concat(*[F.unhex(F.substring(text, 2 * (n - i) - 1, 2)) for i in range(n)])


def bmp(rows: Column, width: Column, height: Column, depth: int = 24) -> Column:
    """A file of top-down rows of blue, green, red bytes: 54 bytes of headers, then the rows bottom-up.

    Rows are padded to four bytes. Null if rows are not height times width pixels.
    """
    stride = (width * (depth // 8)).cast("int")
    padded = F.call_function("div", stride + 3, F.lit(4)) * 4
    size = (padded * height).cast("bigint")
    zero = F.lit(0)
    parts = [F.lit("BM").cast("binary"), le(size + 54, 4), le(zero, 4), le(F.lit(54), 4), le(F.lit(40), 4), le(width, 4), le(height, 4), le(F.lit(1), 2), le(F.lit(depth), 2), le(zero, 4), le(size, 4), le(zero, 4), le(zero, 4), le(zero, 4), le(zero, 4)]
    text = F.hex(rows)
    lines = F.transform(F.sequence(F.lit(1), height.cast("int")), lambda i: F.rpad(F.substring(text, (height.cast("int") - i) * stride * 2 + 1, stride * 2), (padded * 2).cast("int"), F.lit("0")))
    return F.when(F.octet_length(rows) == stride * height, F.concat(*parts, F.unhex(F.array_join(lines, ""))))


def file_name(seq: Column, prefix: str = "image", suffix: str = ".bmp") -> Column:
    return F.concat(F.lit(prefix), seq.cast("string"), F.lit(suffix))
