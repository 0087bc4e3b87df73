"""What the corpus operators share: tables that cut lineage, components, output helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES_A_TASK = 200_000


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and driver and tasks are one process, a temporary folder of
    this session's own; on a cluster such a folder would be seen by one machine only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors and the driver share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends at files every executor sees."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As cut, with the table's path, for discard()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, to size partitions by. One number comes to the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def ragged(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """List array with values[cuts[i]:cuts[i + 1]] in row i."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): component is its smallest node.

    First every node goes over to the smallest among itself and its neighbours, and an
    edge then joins what its ends went over to: a node with its neighbours becomes
    one, and few edges are left for the rounds to read again. In a round a node's label jumps to its label's label, then the node and its
    label's node take the smallest label among the node and its neighbours. That
    is two minima with map-side combining, so a node with very many edges is split
    like any skewed join key. Every round ends in a shared table. Null ends and
    self loops add nothing; an empty graph gives no rows.
    """
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null and a <> b")
    spark = edges.sparkSession
    one_way, given = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # Small label tables as few files; a task has about EDGES_A_TASK edges at most.
    parts = one_way.count() // EDGES_A_TASK + 1
    near = one_way.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x")).select("x.*")
    steps, stepped = stored(near.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("rep")).coalesce(parts), "steps")
    ends = [steps.select(F.col("node").alias(end), F.col("rep").alias(new)) for end, new in (("a", "x"), ("b", "y"))]
    met = one_way.join(ends[0], "a").join(ends[1], "b").where("x <> y")
    sides = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    both, kept = stored(met.select(sides.alias("e")).select("e.*").distinct().coalesce(parts), "edges")
    discard(spark, given)
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels, last = stored(first.coalesce(parts), "labels")
    nothing = F.lit(None).cast("long")
    for _ in range(rounds):
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("low"))
        jumped = labels.withColumn("old", F.col("component")).join(above, "component").select("node", "low", "old")
        near = both.join(jumped.select(F.col("node").alias("b"), "low"), "b").select(F.col("a").alias("node"), "low", nothing.alias("own"), nothing.alias("old"))
        seen = near.unionByName(jumped.withColumn("own", F.col("low"))).groupBy("node").agg(F.min("low").alias("low"), F.max("own").alias("own"), F.max("old").alias("old"))
        hooks = seen.select(F.explode(F.array(F.struct("node", "low", "old"), F.struct(F.col("own").alias("node"), "low", nothing.alias("old")))).alias("x")).select("x.*")
        lowest = hooks.groupBy("node").agg(F.min("low").alias("component"), F.max("old").alias("old"))
        fresh, path = stored(lowest.coalesce(parts), "labels")
        moved = fresh.where("component <> old").limit(1).count()
        discard(spark, last)
        labels, last = fresh.select("node", "component"), path
        if not moved:
            ends = labels.select(F.col("node").alias("rep"), "component")
            out = cut(steps.join(ends, "rep", "left").select("node", F.coalesce("component", "rep").alias("component")), "components")
            for path in (kept, last, stepped):
                discard(spark, path)
            return out
    raise RuntimeError(f"labels still move after {rounds} rounds")
