"""Queries that replay tables as streams, through operators that keep state, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import routing
from ..sinks import batches, multipart
from ..sinks.files import scratch
from ..streaming import framer, pairs, pictures, replay
from . import files, streams  # noqa: F401
from .registry import SQL, query
from .views import PICTURES, Tables


@query(SQL["zip_mix16"])
def zip_stream(t: Tables) -> DataFrame:
    """Two streams mixed by position; later samples of one come before earlier ones of the other."""
    s = t.samples().where("stream_id IN ('click', 'view')").select("seq", (F.col("stream_id") == "click").alias("first"), "pts_hns", "payload")
    parts = [s.where("first AND seq % 3 > 0"), s.where("NOT first AND seq % 2 = 0"), s.where("first AND seq % 3 = 0"), s.where("NOT first AND seq % 2 = 1")]
    zipped = replay.to_end(pairs.zipped(replay.replayed(parts, ["seq"])))
    return zipped.withColumn("mixed", pixel.mix16(F.col("a"), F.col("b")))


@query(SQL["epoch_filter"])
def epoch_stream(t: Tables) -> DataFrame:
    """Rows of the last epoch, of a stream in which earlier epochs' rows come late."""
    sofar = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = t.samples().withColumn("epoch", F.count_if(F.col("stream_id") == "error").over(sofar)).select("user_id", "event_id", "epoch")
    parts = [s.where("event_id % 3 = 1"), s.where("event_id % 3 = 0"), s.where("event_id % 3 = 2")]
    return routing.latest_epoch(replay.to_end(pairs.current(replay.replayed(parts, ["user_id"]), "user_id")), ["user_id"], "epoch")


@query(SQL["ac3_files"].replace('AS at,', 'AS place,').replace("SELECT CAST(l_orderkey AS VARCHAR) AS path,", "SELECT path, seq, size FROM (SELECT CAST(l_orderkey AS VARCHAR) AS path,", 1) + ")")
def frame_stream(t: Tables) -> DataFrame:
    """Frames of audio that comes in chunks of a hundred bytes, which cut frames and their heads."""
    data = files.ac3_contents(t)
    n = F.ceil(F.octet_length("content") / 100).cast("int")
    chunks = data.select(F.col("path").alias("stream_id"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    chunks = chunks.select("stream_id", F.col("i").cast("bigint").alias("seq"), F.substring("content", F.col("i") * 100 + 1, F.lit(100)).alias("data"))
    parts = [chunks.where("seq < 3"), chunks.where("seq BETWEEN 3 AND 5"), chunks.where("seq > 5")]
    found = replay.to_end(framer.framed(replay.replayed(parts, ["stream_id"]), "ac3"))
    return found.select(F.col("stream_id").alias("path"), F.col("frame_no").alias("seq"), F.octet_length("data").cast("bigint").alias("size"))


@query(f"""WITH {PICTURES}, g AS (SELECT *, sum(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS g FROM pictures)
SELECT gop, decode_seq, row_number() OVER (PARTITION BY gop ORDER BY g, temporal_ref, decode_seq) - 1 AS display_seq FROM g""")
def reorder_stream(t: Tables) -> DataFrame:
    """Display order of pictures that come in decode order; a last I picture lets those go that are held."""
    p = t.pictures().select(F.col("gop").cast("string").alias("stream_id"), "decode_seq", "temporal_ref", "ptype")
    last = p.select("stream_id").distinct().select("stream_id", F.lit(1 << 40).alias("decode_seq"), F.lit(0).cast("bigint").alias("temporal_ref"), F.lit("I").alias("ptype"))
    parts = [p.where("decode_seq < 2"), p.where("decode_seq >= 2"), last]
    shown = replay.to_end(pictures.reordered(replay.replayed(parts, ["stream_id"])))
    return shown.select(F.col("stream_id").cast("bigint").alias("gop"), "decode_seq", "display_seq")


#: Bytes of a file of parts.
_PACK = 64 << 20


@query(SQL["http_frames"])
def http_stream(t: Tables) -> DataFrame:
    """Multipart parts as files of a stream's batches, read back by the batches' manifests."""
    spark, folder = t.spark, scratch(t.spark, "batches")
    parts = t.read("documents").select(F.col("doc_id").cast("string").alias("name"), multipart.part(F.col("text").cast("binary")).alias("content"))
    batches.register(spark)
    stream = replay.replayed([parts.where("cast(name AS bigint) % 2 = 0"), parts.where("cast(name AS bigint) % 2 = 1")], ["name"])
    query = stream.writeStream.format("filebatches").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").option("pack", _PACK).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches.contents(spark, f"{folder}/out").select(F.col("name").cast("bigint").alias("doc_id"), F.col("content").cast("string").alias("part"))
