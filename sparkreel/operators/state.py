"""State machines over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import last_known


def transitions(log: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """The log with the state before each event (`start` for the first), by a BIGINT order that is unique in a key."""
    out = last_known(log, keys, order, F.struct(F.col(state).alias("state")), "__earlier", before=True)
    return out.withColumn("from_state", F.coalesce("__earlier.state", F.lit("start"))).drop("__earlier")


def checked(log: DataFrame, keys: list[str], order: str, state: str, allowed: DataFrame) -> DataFrame:
    """The log's transitions with ok: whether (from_state, state) is among the allowed ones, a table of a few rows."""
    moves = transitions(log, keys, order, state)
    legal = allowed.select("from_state", F.col("to_state").alias(state)).distinct().withColumn("__ok", F.lit(True))
    return moves.join(legal, ["from_state", state], "left").withColumn("ok", F.coalesce("__ok", F.lit(False))).drop("__ok")


def ended(log: DataFrame, keys: list[str], stream: str, is_end) -> DataFrame:
    """Streams still open for each presentation, and whether all have ended."""
    streams = log.groupBy(*keys, stream).agg(F.bool_or(is_end).alias("done"))
    return streams.groupBy(*keys).agg(F.count_if(~F.col("done")).alias("pending"), F.bool_and("done").alias("ended"))


def byte_totals(samples: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Bytes and buffers of each stream; a null payload is a buffer without bytes."""
    return samples.groupBy(*keys).agg(F.sum(F.octet_length(payload).cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("buffers"))


def least_level(samples: DataFrame, keys: list[str], level: str, most: float) -> DataFrame:
    """The lowest level of each group, and `most` at most."""
    return samples.groupBy(*keys).agg(F.min(F.least(level, F.lit(most))).alias("level"))
