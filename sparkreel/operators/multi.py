"""Operators with two inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel


def zip_streams(left: DataFrame, right: DataFrame, on: list[str], carry: list[str], names: tuple[str, str] = ("a", "b"), value: str = "payload") -> DataFrame:
    """n-th with n-th sample; the longer side's tail is left out. Columns in `carry` come from the left side."""
    a = left.select(*on, *carry, F.col(value).alias(names[0]))
    b = right.select(*on, F.col(value).alias(names[1]))
    return a.join(b, on)


def mix_streams(left: DataFrame, right: DataFrame, on: list[str], carry: list[str]) -> DataFrame:
    """Saturating 16-bit mix of two zipped streams; times come from the left one."""
    return zip_streams(left, right, on, carry).withColumn("mixed", pixel.mix16(F.col("a"), F.col("b")))


def sequence(first: DataFrame, second: DataFrame, pts: str, duration: Column) -> DataFrame:
    """first, then second shifted by first's total duration, with segment numbers. The total is one row, so it is broadcast."""
    total = first.agg(F.coalesce(duration, F.lit(0)).cast("bigint").alias("__total"))
    shifted = second.crossJoin(F.broadcast(total)).withColumn(pts, F.col(pts) + F.col("__total")).drop("__total")
    return first.withColumn("segment", F.lit(1)).unionByName(shifted.withColumn("segment", F.lit(2)))


def union_streams(**streams: DataFrame) -> DataFrame:
    """Several sources as one, told apart by stream_id."""
    parts = [df.withColumn("stream_id", F.lit(name)) for name, df in streams.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Attributes of codes from a code table; unknown codes give null. Catalyst broadcasts the table if its size allows."""
    return df.join(table, on, "left")


def answered(samples: DataFrame, requests: DataFrame, on: str) -> DataFrame:
    """n-th sample with n-th request; what one side has more of is left out."""
    return samples.join(requests, on)
