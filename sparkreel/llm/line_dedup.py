"""Line dedup with overlapping three-line windows, in DataFrame functions only.

Lines are what newlines separate. Windows run over consecutive lines that are
not blank, compared after trimming spaces. Of equal windows the first one (by
document id, then place) stays; the places that later ones cover are merged to
ranges of lines and removed, blank lines inside a range too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 3


def _windows(lines: Column, width: int) -> Column:
    """array<struct<hi, lo, start, stop>> of the windows of an array of lines; stop is exclusive."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t")))
    solid = F.filter(numbered, lambda x: x["t"] != "")
    count = F.greatest(F.size(solid) - (width - 1), F.lit(0))
    rows = F.transform(F.slice(solid, 1, count), lambda x: F.struct(F.xxhash64(F.lit(1), x["t"]).alias("hi"), F.xxhash64(F.lit(2), x["t"]).alias("lo"), x["i"].alias("start"), (x["i"] + 1).alias("stop")))
    for j in range(1, width):
        rows = F.zip_with(
            rows,
            F.slice(solid, 1 + j, count),
            lambda row, x: F.struct(F.xxhash64(row["hi"], x["t"]).alias("hi"), F.xxhash64(row["lo"], x["t"]).alias("lo"), row["start"].alias("start"), (x["i"] + 1).alias("stop")),
        )
    return rows


def repeated_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, print, start, stop: merged ranges of lines that later occurrences of a window cover.

    print is a hash of the text, so rows that share an id are told apart.
    """
    windows = docs.where("doc_id is not null").select("doc_id", "print", F.explode(_windows(F.col("lines"), width)).alias("w")).select("doc_id", "print", "w.*")
    place = F.struct("doc_id", "print", "start")
    firsts = windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = windows.join(firsts, ["hi", "lo"]).where(place > F.col("first")).select("doc_id", "print", "start", "stop")
    before = Window.partitionBy("doc_id", "print").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = later.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("doc_id", "print", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def dedup_lines(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, text and the columns in keep for every row of docs: text without later occurrences of windows.

    Null text stays null and has no lines; an empty text has one empty line. Rows
    without an id take no part and stay as they are. Documents with fewer than
    `width` lines that are not blank have no window. Equal rows (id and text) are
    one document, cut alike. Other columns are not read.
    """
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
        F.split(F.col("text").cast("string"), "\n", -1).alias("lines"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).alias(c) for c in keep]).alias("kept"),
    )
    ranges = repeated_ranges(parts.drop("kept").where("size(lines) >= %d" % width), width)
    cuts = ranges.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    joined = parts.join(cuts, ["doc_id", "print"], "left")
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("lines").isNull(), 0).otherwise(n)
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda r: r["stop"]))
    stops = F.concat(F.transform("cuts", lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda r: F.slice(F.col("lines"), r["a"] + 1, r["b"] - r["a"])))
    removed = F.coalesce(F.aggregate("cuts", F.lit(0), lambda total, r: total + r["stop"] - r["start"]), F.lit(0))
    text = F.array_join(F.when(F.col("cuts").isNull(), F.col("lines")).otherwise(kept), "\n")
    return joined.select("doc_id", n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias("text"), *[F.col("kept").getField(c).alias(c) for c in keep])
