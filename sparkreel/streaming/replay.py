"""Tables replayed as streams, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sinks.files import scratch

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(parts: list[DataFrame], keys: list[str], files: int | None = None) -> DataFrame:
    """A stream of the parts' rows: each part comes after the one before, and a key's rows of a part together. A part has as many files as a shuffle has partitions."""
    spark = parts[0].sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "replay")
    for part in parts:
        part.repartition(files, *keys).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def to_end(stream: DataFrame) -> DataFrame:
    """What a stream gives until its input is over, as a table; state is kept in RocksDB, checkpoints in the shared folder."""
    spark: SparkSession = stream.sparkSession
    folder, name = scratch(spark, "stream"), _STORE[0]
    before = spark.conf.get(name)
    spark.conf.set(*_STORE)
    try:
        # A query takes the session's settings when it starts.
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
