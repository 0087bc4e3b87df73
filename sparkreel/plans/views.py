"""Sample-stream views over the test tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline

#: Rows of a task's part of a table.
DEAL = 1_000_000


class Tables:
    """The Parquet tables of one folder, and the stream views made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, name: str) -> int:
        """Tasks of a bounded number of a table's rows. The count comes from the files' footers."""
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(self.read(name).count() / DEAL))

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A table dealt by keys to tasks of a bounded number of rows, so that what a task sorts does not grow with the table."""
        return self.read(name).repartition(self.tasks(name), *keys)

    def samples(self) -> DataFrame:
        """stream_id, event_id, user_id, pts_hns, payload, seq: events as samples, numbered in each stream."""
        e = self.read("events").select(
            F.col("event_type").alias("stream_id"), "event_id", "user_id",
            (F.unix_micros(F.col("ts").cast("timestamp")) * 10).alias("pts_hns"),
            F.floor(F.col("value") * 100).cast("bigint").alias("payload"),
        )
        return timeline.numbered(e, ["stream_id"], "event_id", "seq")

    def pictures(self) -> DataFrame:
        """gop, decode_seq, temporal_ref, ptype, line: lineitem as coded pictures. line is a number for each row of the gop."""
        from pyspark.sql import Window

        gop = Window.partitionBy("l_orderkey")
        return self.dealt("lineitem", "l_orderkey").select(
            F.col("l_orderkey").alias("gop"),
            (F.row_number().over(gop.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).cast("bigint").alias("decode_seq"),
            (F.row_number().over(gop.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber")) - 1).cast("bigint").alias("temporal_ref"),
            F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "P").otherwise("B").alias("ptype"),
            F.floor("l_quantity").cast("bigint").alias("size"),
        )

    def pixels(self) -> DataFrame:
        """l_orderkey, l_linenumber, l_partkey, l_suppkey, y, u, v"""
        return self.read("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 256).alias("y"), (F.col("l_suppkey") * 7 % 256).alias("u"), (F.col("l_orderkey") % 256).alias("v")
        )

    def blocks(self) -> DataFrame:
        """page_id, data: 32 fixed pseudo-random bytes for each page."""
        return self.read("pages").select("page_id", F.unhex(F.concat(F.md5(F.col("url").cast("binary")), F.md5(F.concat(F.col("url"), F.lit("#")).cast("binary")))).alias("data"))


SAMPLES = """samples AS (SELECT event_type AS stream_id, event_id, user_id, epoch_us(ts) * 10 AS pts_hns, CAST(floor(value * 100) AS BIGINT) AS payload,
  CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS seq FROM events)"""

PICTURES = """pictures AS (SELECT l_orderkey AS gop,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS decode_seq,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_linenumber) - 1 AS BIGINT) AS temporal_ref,
  CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'N' THEN 'P' ELSE 'B' END AS ptype, CAST(floor(l_quantity) AS BIGINT) AS size FROM lineitem)"""

PIXELS = """pixels AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 256 AS y, l_suppkey * 7 % 256 AS u, l_orderkey % 256 AS v FROM lineitem)"""

BLOCKS = """blocks AS (SELECT page_id, md5(url) || md5(url || '#') AS h FROM pages)"""


def word(at: int, n: int, text: str = "h") -> str:
    """SQL of n bytes (7 at most) from byte `at` of a hex text as a number."""
    return f"CAST('0x' || substr({text}, {2 * at + 1}, {2 * n}) AS BIGINT)"


def field(at: int, n: int, first: int, count: int) -> str:
    """SQL of `count` bits from bit `first` of the n bytes from byte `at`."""
    return f"(({word(at, n)} >> {8 * n - first - count}) & {(1 << count) - 1})"
