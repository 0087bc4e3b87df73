"""Selection, routing and typing of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_streams(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples of the streams that the catalog selects; pushes down to a scan as a semi join."""
    return samples.join(catalog.where("selected").select("stream_id"), "stream_id", "left_semi")


def route(samples: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Samples of the named streams, with the name of their output."""
    names = reduce(lambda acc, kv: F.when(F.col("stream_id") == kv[0], F.lit(kv[1])).otherwise(acc), targets.items(), F.lit(None).cast("string"))
    return samples.where(F.col("stream_id").isin(*targets)).withColumn("target", names)


def without_payload(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """All samples; the payload of streams that are not selected is null."""
    chosen = catalog.select("stream_id", "selected")
    return samples.join(chosen, "stream_id", "left").withColumn("payload", F.when(F.col("selected"), F.col("payload"))).drop("selected")


def latest_epoch(df: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """Rows of each stream's last epoch; results of earlier ones are stale."""
    last = df.groupBy(*keys).agg(F.max(epoch).alias(epoch))
    return df.join(last, [*keys, epoch], "left_semi")


def negotiate(offers: Column, accepts: Column) -> Column:
    """The first offered type that is accepted, or null."""
    return F.get(F.filter(offers, lambda x: F.array_contains(accepts, x)), F.lit(0))


def frame_bytes(subtype: Column, width: Column, height: Column) -> Column:
    """Bytes of a frame by pixel format; null for others."""
    area = width.cast("bigint") * height
    return F.when(subtype.isin("NV12", "YV12", "I420"), F.call_function("div", area * 3, F.lit(2))).when(subtype == "RGB24", area * 3).when(subtype == "RGB32", area * 4)


def valid_selection(catalog: DataFrame, key: str) -> DataFrame:
    """Whether each presentation selects a stream at all."""
    return catalog.groupBy(key).agg(F.bool_or("selected").alias("ok"))


def accepted(subtype: Column, width: Column, height: Column, subtypes: tuple[str, ...], most_width: int) -> Column:
    """Whether a part takes a video type: one of its subtypes, with a size that is not empty nor too wide."""
    return subtype.isin(*subtypes) & (width > 0) & (height > 0) & (width <= most_width)


def same_type(one: Column, other: Column) -> Column:
    """Whether two types are equal in all fields; missing fields are equal to missing ones."""
    return one.eqNullSafe(other)


def video_type(subtype: Column, width: Column, height: Column) -> Column:
    """A video type with its size in words."""
    return F.struct(F.lit("video").alias("major"), subtype.alias("subtype"), width.alias("width"), height.alias("height"), F.concat_ws("x", width, height).alias("size"))


def without_streams(samples: DataFrame, *names: str) -> DataFrame:
    """Samples of all streams but the named ones."""
    return samples.where(~F.col("stream_id").isin(*names))
