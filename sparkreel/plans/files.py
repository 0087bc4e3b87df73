"""Queries of whole files: their bytes are built of table columns, then read by the sources' operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import headers
from ..functions.sync import first_sync
from ..operators import framing
from ..sinks import files as file_sink
from ..sinks import images, wave
from ..sources import containers, split
from . import graph, pipeline
from .registry import query
from .views import PICTURES, PIXELS, SAMPLES, Tables

#: Lines of an order, in the order of its file's records.
_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_BY = ", ".join(_PLACE)


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


#: Zeros that a record's fillings are cut from.
_FILL = 512


def _zeros(n: Column) -> Column:
    # rpad puts its pattern there byte by byte.
    n = n.cast("int")
    return F.when(n <= _FILL, F.substring(F.lit(bytes(_FILL)), F.lit(1), n)).otherwise(F.rpad(F.lit(b""), n, F.lit(b"\0")))


def _files(t: Tables, begin: str, record: Column) -> containers.Built:
    """One file for each order: what files begin with, in hex, then its lines' records one after the other."""
    return containers.Built(t.read("lineitem"), "l_orderkey", _PLACE, record, bytes.fromhex(begin), t.tasks("lineitem"))


def _large_files(t: Tables, begin: Column, record: Column, suffix: str) -> str:
    """A folder of files with the lines of a thousand order keys each."""
    rows = t.read("lineitem").withColumn("file", F.floor(F.col("l_orderkey") / 1000).cast("bigint"))
    joined = framing.joined_runs(rows, ["file"], ["l_orderkey", *_PLACE], record, t.tasks("lineitem"))
    folder = file_sink.scratch(t.spark, "containers")
    file_sink.register(t.spark)
    named = joined.select(F.concat(F.col("file").cast("string"), F.lit(suffix)).alias("name"), F.concat(begin, "joined").alias("content"))
    named.write.format("namedfiles").mode("append").save(folder)
    return folder


def _flv_record() -> Column:
    """Audio, video and script tags with at least five bytes each."""
    kind, size, ms, late = F.col("l_partkey") % 3, F.col("l_suppkey") % 50 + 5, F.col("l_partkey") * 40, F.col("l_suppkey") % 7
    video = F.concat(F.when(late % 2 == 0, _hex("17")).otherwise(_hex("27")), _hex("01"), B.to_be(late, 3))
    body = F.when(kind == 0, _hex("AF01000000")).when(kind == 1, video).otherwise(_hex("0200000000"))
    code = F.when(kind == 0, _hex("08")).when(kind == 1, _hex("09")).otherwise(_hex("12"))
    head = [_hex("00000000"), code, B.to_be(size, 3), B.to_be(ms % (1 << 24), 3), B.to_be(F.shiftright(ms, 24), 1), _hex("000000")]
    return F.concat(*head, body, _zeros(size - 5))


_FLV = "464C56010500000009"


def _flv_files(t: Tables) -> containers.Built:
    return _files(t, _FLV, _flv_record())


_TAGS = f"""r AS (SELECT l_orderkey, row_number() OVER w - 1 AS seq, l_partkey % 3 AS kind, l_suppkey % 50 + 5 AS size, l_partkey * 40 AS ms, l_suppkey % 7 AS late,
  CAST(9 + coalesce(sum(15 + l_suppkey % 50 + 5) OVER (PARTITION BY l_orderkey ORDER BY {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_BY})),
n AS (SELECT *, CASE kind WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'script' END AS stream_id, 10000 * (ms + CASE kind WHEN 1 THEN late ELSE 0 END) AS pts_hns FROM r)"""


@query(f"""WITH {_TAGS} SELECT CAST(l_orderkey AS VARCHAR) AS path, seq, "at", stream_id, size, ms, pts_hns, pts_hns - coalesce(lag(pts_hns) OVER (PARTITION BY l_orderkey, stream_id ORDER BY seq), 0) AS dur_hns,
CASE kind WHEN 1 THEN late % 2 = 0 END AS key, CAST(NULL AS VARCHAR) AS error FROM n""")
def flv_files(t: Tables) -> DataFrame:
    """Tags of FLV files with their streams, times, durations and key flags."""
    rows = containers.flv_rows(_flv_files(t), payload=False)
    return rows.select("path", "seq", "at", "stream_id", "size", "ms", "pts_hns", "dur_hns", F.col("video.key").alias("key"), "error")


_MANY_TAGS = f"""r AS (SELECT l_orderkey // 1000 AS file, row_number() OVER w - 1 AS seq, l_partkey % 3 AS kind, l_suppkey % 50 + 5 AS size, l_partkey * 40 AS ms, l_suppkey % 7 AS late,
  CAST(9 + coalesce(sum(15 + l_suppkey % 50 + 5) OVER (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 1000 ORDER BY l_orderkey, {_BY})),
n AS (SELECT *, CASE kind WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'script' END AS stream_id, 10000 * (ms + CASE kind WHEN 1 THEN late ELSE 0 END) AS pts_hns FROM r)"""
#: A range of a file; the files of the queries below have many.
_RANGE = 16_384


@query(f"""WITH {_MANY_TAGS} SELECT file || '.flv' AS path, seq, "at", stream_id, size, ms, pts_hns, pts_hns - coalesce(lag(pts_hns) OVER (PARTITION BY file, stream_id ORDER BY seq), 0) AS dur_hns,
CASE kind WHEN 1 THEN late % 2 = 0 END AS key, CAST(NULL AS VARCHAR) AS error FROM n""")
def flv_ranges(t: Tables) -> DataFrame:
    """Tags of larger FLV files in a folder, each read by several tasks."""
    rows = containers.flv(t.spark, _large_files(t, _hex(_FLV), _flv_record(), ".flv"), payload=False, width=_RANGE)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), "seq", "at", "stream_id", "size", "ms", "pts_hns", "dur_hns", F.col("video.key").alias("key"), "error")


@query(f"""WITH {_MANY_TAGS} SELECT file || '.flv' AS path, seq, "at", size, '27' || '01' || printf('%06X', CAST(late AS BIGINT)) || repeat('00', CAST(size - 5 AS INTEGER)) AS payload FROM n WHERE kind = 1 AND late % 2 = 1
UNION ALL SELECT file || '.flv', seq, "at", size, '17' || '01' || printf('%06X', CAST(late AS BIGINT)) || repeat('00', CAST(size - 5 AS INTEGER)) FROM n WHERE kind = 1 AND late % 2 = 0""")
def flv_selected(t: Tables) -> DataFrame:
    """Payloads of the video tags alone: the reader takes the filter over and passes by the other tags' bytes."""
    rows = split.records(t.spark, _large_files(t, _hex(_FLV), _flv_record(), ".flv"), "flv", width=_RANGE)
    return rows.where("code = 9").select(F.element_at(F.split("path", "/"), -1).alias("path"), "seq", "at", "size", F.hex("payload").alias("payload"))


@query(f"""WITH {_MANY_TAGS} SELECT file || '.flv' AS path, CAST(CASE kind WHEN 0 THEN 8 ELSE 9 END AS BIGINT) AS code, arg_min(pts_hns, seq) AS first_pts, arg_max(pts_hns, seq) AS last_pts, arg_max(pts_hns, seq) - arg_min(pts_hns, seq) AS dur_hns FROM n WHERE kind < 2 GROUP BY file, kind""")
def flv_durations(t: Tables) -> DataFrame:
    """Times of the first and last audio and video tags of the same files, read from their ends."""
    found = split.durations(t.spark, _large_files(t, _hex(_FLV), _flv_record(), ".flv"), "flv", {8, 9})
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), "code", "first_pts", "last_pts", "dur_hns")


@query(f"""WITH {_TAGS} SELECT CAST(l_orderkey AS VARCHAR) AS path, stream_id, count(*) AS samples, CAST(sum(size) AS BIGINT) AS bytes, arg_min(pts_hns, seq) AS first_pts, arg_max(pts_hns, seq) AS last_pts,
arg_max(pts_hns, seq) - arg_min(pts_hns, seq) AS dur_hns FROM n GROUP BY l_orderkey, stream_id""")
def flv_catalog(t: Tables) -> DataFrame:
    """Streams of the same files."""
    return containers.catalog(containers.flv_rows(_flv_files(t)))


def _program_sql(key: str, order: str, path: str) -> str:
    return f"""WITH r AS (SELECT {key} AS file, row_number() OVER w - 1 AS i, l_partkey, l_suppkey % 40 AS n, l_suppkey % 3 AS junk,
  coalesce(sum(14 + 17 + l_suppkey % 40 + l_suppkey % 3) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM lineitem WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
u AS (SELECT file, 2 * i AS seq, "at", 186 AS code, 14 AS size, NULL AS kind, NULL AS number, l_partkey * 300 AS scr, NULL AS pts FROM r UNION ALL
SELECT file, 2 * i + 1, "at" + 14, CASE l_partkey % 2 WHEN 0 THEN 192 + l_partkey % 32 ELSE 224 + l_partkey % 16 END, 17 + n - 3, CASE l_partkey % 2 WHEN 0 THEN 'audio' ELSE 'video' END, CASE l_partkey % 2 WHEN 0 THEN l_partkey % 32 ELSE l_partkey % 16 END, NULL, l_partkey * 300 FROM r)
SELECT {path} AS path, seq, CAST("at" AS BIGINT) AS "at", CAST(code AS BIGINT) AS code, CAST(CASE code WHEN 186 THEN 14 ELSE size END AS BIGINT) AS size, kind, CAST(number AS BIGINT) AS number, CAST(scr AS BIGINT) AS scr, CAST(pts AS BIGINT) AS pts FROM u"""


def _program_record() -> Column:
    """A pack and a packet, with up to two bytes after them that belong to none."""

    def stamp(mark: int, value: Column) -> Column:
        word = B.pack((F.lit(mark), 36), (B.bits(value, 33, 0, 3), 33), (F.lit(1), 32), (B.bits(value, 33, 3, 15), 17), (F.lit(1), 16), (B.bits(value, 33, 18, 15), 1), (F.lit(1), 0))
        return B.to_be(word, 5)

    clock, n = F.col("l_partkey") * 300, F.col("l_suppkey") % 40
    scr = B.pack((F.lit(1), 46), (B.bits(clock, 33, 0, 3), 43), (F.lit(1), 42), (B.bits(clock, 33, 3, 15), 27), (F.lit(1), 26), (B.bits(clock, 33, 18, 15), 11), (F.lit(1), 10), (F.lit(1), 0))
    pack = F.concat(_hex("000001BA"), B.to_be(scr, 6), _hex("000003F8"))
    code = F.when(F.col("l_partkey") % 2 == 0, 192 + F.col("l_partkey") % 32).otherwise(224 + F.col("l_partkey") % 16)
    packet = F.concat(_hex("000001"), B.to_be(code, 1), B.to_be(n + 8, 2), _hex("808005"), stamp(2, clock), _zeros(n))
    junk = F.unhex(F.repeat(F.lit("FF"), (F.col("l_suppkey") % 3).cast("int")))
    # A packet's own length counts what follows it: three flag bytes, the stamp, the data.
    return F.concat(pack, packet, _hex("FFFFFF"), junk)


def _packets() -> list[Column]:
    return [*map(F.col, ("seq", "at", "code", "size", "kind", "number")), F.col("pack.scr").alias("scr"), F.col("packet.pts").alias("pts")]


@query(_program_sql("l_orderkey", _BY, "CAST(file AS VARCHAR)"))
def program_files(t: Tables) -> DataFrame:
    """Packs and packets of program streams, with bytes between them that belong to none."""
    return containers.mpegps_rows(_files(t, "", _program_record()), payload=False).select("path", *_packets())


@query(_program_sql("(l_orderkey // 1000)", f"l_orderkey, {_BY}", "file || '.mpg'"))
def program_ranges(t: Tables) -> DataFrame:
    """Packs and packets of larger program streams in a folder, each read by several tasks."""
    rows = containers.mpegps(t.spark, _large_files(t, F.lit("").cast("binary"), _program_record(), ".mpg"), payload=False, width=_RANGE)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), *_packets())


def _frames_sql(size: str, junk: str) -> str:
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER w - 1 AS seq, CAST(coalesce(sum({size} + {junk}) OVER (PARTITION BY l_orderkey ORDER BY {_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at,
CAST({size} AS BIGINT) AS size FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_BY})"""


@query(_frames_sql("(144000 * 128 // 44100 + l_partkey % 2)", "l_suppkey % 5"))
def mpa_files(t: Tables) -> DataFrame:
    """Frames of MPEG audio files, with up to four bytes between them."""
    pad = F.col("l_partkey") % 2
    frame = F.concat(_hex("FFFB"), F.when(pad == 1, _hex("92")).otherwise(_hex("90")), _hex("00"), _zeros(F.lit(413) + pad), _zeros(F.col("l_suppkey") % 5))
    return containers.mpa_rows(_files(t, "", frame), payload=False).select("path", "seq", "at", "size")


_AC3_SIZE = "(4 * [32, 40, 48, 56][CAST(1 + l_partkey % 4 AS BIGINT)])"


def _ac3(t: Tables) -> containers.Built:
    """Frames of AC-3, with up to four bytes between them."""
    code = F.col("l_partkey") % 4
    size = F.element_at(F.array(*[F.lit(4 * x) for x in (32, 40, 48, 56)]), (code + 1).cast("int"))
    frame = F.concat(_hex("0B770000"), B.to_be(code * 2, 1), _hex("4040"), _zeros(size - 7), _zeros(F.col("l_suppkey") % 5))
    return _files(t, "", frame)


def ac3_contents(t: Tables) -> DataFrame:
    """path, content of the same files."""
    return _ac3(t).contents()


@query(_frames_sql(_AC3_SIZE, "l_suppkey % 5"))
def ac3_files(t: Tables) -> DataFrame:
    """Frames of AC-3 files."""
    return containers.ac3_rows(_ac3(t), payload=False).select("path", "seq", "at", "size")


@query("""WITH p AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages), e AS (SELECT page_id, unnest(range(1, len(parts))) AS i, parts FROM p)
SELECT page_id, CAST(octet_length(encode(array_to_string(parts[1:i], '<p>'))) AS BIGINT) AS at, CAST('0x' || substr(hex(encode(array_to_string(parts[i + 1:], '<p>'))), 1, 2) AS BIGINT) AS code FROM e WHERE octet_length(encode(array_to_string(parts[i + 1:], ''))) > 0""")
def start_codes(t: Tables) -> DataFrame:
    """Every 00 00 01 with the byte after it, in pages whose <p> stand for it."""
    data = F.replace("html", F.lit("<p>"), F.lit("\x00\x00\x01")).cast("binary")
    return framing.start_codes(t.read("pages").select("page_id", data.alias("data")), "data", ["page_id"]).where("code is not null")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL ELSE p_partkey % 9 END AS at FROM part""")
def sync_search(t: Tables) -> DataFrame:
    """Where the first audio sync word stands behind bytes of which pairs of halves look like it."""
    junk = F.unhex(F.repeat(F.lit("B7"), (F.col("p_partkey") % 9).cast("int")))
    data = F.when(F.col("p_size") % 4 == 0, junk).otherwise(F.concat(junk, _hex("0B7701")))
    return t.read("part").select("p_partkey", first_sync(data, "0B77").cast("bigint").alias("at"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 9 AS at, p_partkey % 4096 AS width, CAST(p_size % 4096 AS BIGINT) AS height, p_partkey % 17 AS aspect, p_size % 10 AS rate FROM part)
SELECT p_partkey, "at", width, height, CASE WHEN aspect BETWEEN 1 AND 14 THEN [10000, 6735, 7031, 7615, 8055, 8437, 8935, 9157, 9815, 10255, 10695, 10950, 11575, 12015][aspect] END AS num, CASE WHEN aspect BETWEEN 1 AND 14 THEN 10000 END AS den,
CASE WHEN rate BETWEEN 1 AND 8 THEN [24000, 24, 25, 30000, 30, 50, 60000, 60][rate] END AS rate_num FROM p""")
def sequence_resync(t: Tables) -> DataFrame:
    """A sequence header behind other bytes, with the pixel aspect by version 1 codes."""
    p = t.read("part").select("p_partkey", (F.col("p_partkey") % 9).cast("int").alias("at"), (F.col("p_partkey") % 4096).alias("width"), (F.col("p_size") % 4096).alias("height"), (F.col("p_partkey") % 17).alias("aspect"), (F.col("p_size") % 10).alias("rate"))
    aspect = F.when(F.col("aspect") < 16, F.col("aspect")).otherwise(0)
    word = B.pack((F.col("width"), 20), (F.col("height"), 8), (aspect, 4), (F.col("rate"), 0))
    data = F.concat(F.unhex(F.repeat(F.lit("10"), F.col("at"))), _hex("000001B3"), B.to_be(word, 4), _hex("00012000"))
    out = p.select("p_partkey", data.alias("data")).select("p_partkey", headers.found_sequence_header(F.col("data"), mpeg1=True).alias("x"))
    return out.select("p_partkey", F.col("x.at").alias("at"), F.col("x.header.width").alias("width"), F.col("x.header.height").alias("height"), F.col("x.aspect.num").cast("int").alias("num"), F.col("x.aspect.den").cast("int").alias("den"), F.col("x.header.rate_num").cast("int").alias("rate_num"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 256 AS profile, p_size % 256 AS level, 1 + p_size % 4 AS sps, p_partkey % 3 AS pps FROM part)
SELECT p_partkey, profile, CAST(level AS BIGINT) AS level, '67' || repeat('AB', sps) AS sps, CASE WHEN pps > 0 THEN '68' || repeat('CD', pps) END AS pps,
CASE WHEN pps > 0 THEN '00000167' || repeat('AB', sps) || '00000168' || repeat('CD', pps) END AS record FROM p""")
def avc_configuration(t: Tables) -> DataFrame:
    """Parameter sets of AVC configuration tags; the picture set is the second's neighbour or missing."""
    sps, pps = (F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 3).cast("int")
    sets = F.concat(_hex("E1"), B.to_be(sps + 1, 2), _hex("67"), F.unhex(F.repeat(F.lit("AB"), sps)))
    picture = F.when(pps > 0, F.concat(_hex("01"), B.to_be(pps + 1, 2), _hex("68"), F.unhex(F.repeat(F.lit("CD"), pps)))).otherwise(_hex("00"))
    data = F.concat(_hex("170000000001"), B.to_be(F.col("p_partkey") % 256, 1), _hex("00"), B.to_be(F.col("p_size") % 256, 1), _hex("FF"), sets, picture)
    x = t.read("part").select("p_partkey", data.alias("data")).select("p_partkey", headers.avc_config(F.col("data")).alias("x"))
    return x.select("p_partkey", "x.profile", "x.level", *[F.hex(f"x.{c}").alias(c) for c in ("sps", "pps", "record")])


@query("""WITH p AS (SELECT p_partkey, p_partkey % 8 AS form, p_partkey % 256 AS a, CAST(p_size % 256 AS BIGINT) AS b, p_partkey % 3 AS codec FROM part)
SELECT p_partkey, CASE codec WHEN 0 THEN CASE form WHEN 0 THEN a WHEN 1 THEN a * 256 + b WHEN 2 THEN 352 WHEN 3 THEN 176 WHEN 4 THEN 128 WHEN 5 THEN 320 WHEN 6 THEN 160 END WHEN 1 THEN b * 16 - 3 END AS width,
CASE codec WHEN 0 THEN CASE form WHEN 0 THEN b WHEN 1 THEN b * 256 + a WHEN 2 THEN 288 WHEN 3 THEN 144 WHEN 4 THEN 96 WHEN 5 THEN 240 WHEN 6 THEN 120 END WHEN 1 THEN a * 16 - 5 END AS height FROM p""")
def flv_video_size(t: Tables) -> DataFrame:
    """Picture sizes in tags of H.263, VP6 and AVC (which has none)."""
    a, b, codec, form = F.col("p_partkey") % 256, F.col("p_size") % 256, F.col("p_partkey") % 3, F.col("p_partkey") % 8
    custom = F.when(form == 0, B.pack((a, 31), (b, 23))).otherwise(B.pack((a, 31), (b, 23), (b, 15), (a, 7)))
    # 30 bits of start code, version and reference, the size code, then sizes: 10 bytes, of which the last 6 hold the varying bits.
    word = F.shiftleft(form, 39).bitwiseOR(F.when(form < 2, custom).otherwise(0))
    h263 = F.concat(_hex("22000080"), B.to_be(word, 6))
    vp6 = F.concat(_hex("1435"), _hex("0000"), B.to_be(a, 1), B.to_be(b, 1), _hex("00000000"))
    data = F.when(codec == 0, h263).when(codec == 1, vp6).otherwise(_hex("17010000000000000000"))
    return t.read("part").select("p_partkey", headers.flv_size(data).alias("x")).select("p_partkey", "x.*")


def _le(value: str, n: int) -> str:
    return " || ".join(f"substr(printf('%0{2 * n}X', CAST({value} AS BIGINT)), {2 * (n - i) - 1}, 2)" for i in range(n))


@query(f"""WITH s AS (SELECT s_nationkey, string_agg(hex(encode(s_name)), '' ORDER BY s_suppkey) AS data FROM supplier GROUP BY s_nationkey)
SELECT s_nationkey, hex(encode('RIFF')) || {_le("36 + length(data) // 2", 4)} || hex(encode('WAVEfmt ')) || '10000000' || '01000100' || {_le("8000", 4)} || {_le("8000", 4)} || '01000800' || hex(encode('data')) || {_le("length(data) // 2", 4)} || data AS content FROM s""")
def wave_files(t: Tables) -> DataFrame:
    """WAV files of 8-bit samples: the header part and the payload parts in order."""
    samples = t.read("supplier").select("s_nationkey", "s_suppkey", F.col("s_name").cast("binary").alias("payload"))
    parts = wave.parts(samples, ["s_nationkey"], "s_suppkey", "payload", 1, 8000, 8)
    # The header's order is null, which sorts first.
    return framing.coalesced(parts.select("s_nationkey", "s_suppkey", F.hex("bytes").alias("bytes")), ["s_nationkey"], "s_suppkey", "bytes").select("s_nationkey", F.col("joined").alias("content"))


@query(f"""WITH p AS (SELECT p_partkey, printf('%02X', p_partkey % 256) AS a, printf('%02X', p_size % 256) AS b FROM part)
SELECT p_partkey, '424D' || {_le("70", 4)} || '00000000' || {_le("54", 4)} || {_le("40", 4)} || {_le("2", 4)} || {_le("2", 4)} || '0100' || '1800' || '00000000' || {_le("16", 4)} || repeat('00', 16) || repeat(b, 6) || '0000' || repeat(a, 6) || '0000' AS content,
'image' || p_partkey || '.bmp' AS name FROM p""")
def bitmap_files(t: Tables) -> DataFrame:
    """Bitmaps of two rows of two pixels, and their names."""
    one, two = (F.repeat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), 6) for c in ("p_partkey", "p_size"))
    image = images.bmp(F.unhex(F.concat(one, two)), F.lit(2), F.lit(2))
    return t.read("part").select("p_partkey", F.hex(image).alias("content"), images.file_name(F.col("p_partkey")).alias("name"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, hex(encode(text)[5:8]) AS head, hex(encode(text)[-4:]) AS tail FROM documents""")
def file_ranges(t: Tables) -> DataFrame:
    """Bytes from the fifth on, and the last four, of texts as files."""
    files = t.read("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    head = containers.range_rows(files, 4, 4).select("path", "size", F.hex("data").alias("head"))
    return head.join(containers.range_rows(files, -4, 4).select("path", F.hex("data").alias("tail")), "path")


_HOUR = 36_000_000_000


@query(f"""WITH s AS (SELECT user_id AS stream_id, min(epoch_us(ts)) * 10 AS a, max(epoch_us(ts)) * 10 AS b FROM events GROUP BY user_id)
SELECT stream_id, seq, CAST(a + seq * {_HOUR} AS BIGINT) AS pts_hns, CAST({_HOUR} AS BIGINT) AS dur_hns FROM (SELECT *, unnest(range(CAST((b - a + {_HOUR - 1}) // {_HOUR} AS BIGINT))) AS seq FROM s WHERE b > a)""")
def screen_frames(t: Tables) -> DataFrame:
    """Frames, one an hour, of captures that run from a user's first event to the last."""
    pts = F.unix_micros(F.col("ts").cast("timestamp")) * 10
    spans = t.read("events").groupBy(F.col("user_id").alias("stream_id")).agg(F.min(pts).alias("begin_hns"), F.max(pts).alias("end_hns"))
    return containers.screen_frames(spans, _HOUR)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(0 AS BIGINT) AS seq, CAST(400000 + 10000 * (p_size % 5) AS BIGINT) AS pts_hns, p_size % 2 = 0 AS key, printf('%08X', CAST(1 + p_partkey % 7 AS BIGINT)) || '65' || repeat('AB', CAST(p_partkey % 7 AS INTEGER)) AS units FROM part""")
def avc_pictures(t: Tables) -> DataFrame:
    """AVC units of FLV files of one tag, behind none to two supplemental units."""
    head = F.when(F.col("p_size") % 2 == 0, _hex("17")).otherwise(_hex("27"))
    extra, n = F.unhex(F.repeat(F.lit("00000003060102"), (F.col("p_partkey") % 3).cast("int"))), (F.col("p_partkey") % 7).cast("int")
    body = F.concat(head, _hex("01"), B.to_be(F.col("p_size") % 5, 3), extra, B.to_be(n + 1, 4), _hex("65"), F.unhex(F.repeat(F.lit("AB"), n)))
    record = F.concat(_hex("0000000009"), B.to_be(F.octet_length(body), 3), _hex("00002800000000"), body)
    rows = containers.flv_rows(t.read("part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(_hex(_FLV), record).alias("content")))
    return containers.avc_units(rows).select("path", "seq", "pts_hns", "key", F.hex("units").alias("units"))


@query(f"""WITH RECURSIVE p AS (SELECT l_orderkey // 50 AS s, row_number() OVER (PARTITION BY l_orderkey // 50 ORDER BY l_orderkey, {_BY}) - 1 AS i, CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'N' THEN 'P' ELSE 'B' END AS ptype,
  CASE WHEN l_suppkey % 4 > 0 THEN l_partkey END AS pts, CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey - 1 END AS dts FROM lineitem),
c AS (SELECT *, count(pts) OVER (PARTITION BY s ORDER BY i) AS have FROM p),
q AS (SELECT s, have - 1 AS j, pts, coalesce(dts <> pts, false) AS late FROM c WHERE pts IS NOT NULL),
r AS (SELECT DISTINCT s, CAST(-1 AS BIGINT) AS i, '' AS ptype, CAST(0 AS BIGINT) AS h, CAST(NULL AS BIGINT) AS time FROM c
  UNION ALL SELECT c.s, c.i, c.ptype, r.h + CASE WHEN r.h < c.have AND NOT (c.ptype = 'B' AND q.late) THEN 1 ELSE 0 END, CASE WHEN r.h < c.have AND NOT (c.ptype = 'B' AND q.late) THEN q.pts END
  FROM r JOIN c ON c.s = r.s AND c.i = r.i + 1 LEFT JOIN q ON q.s = r.s AND q.j = r.h)
SELECT CAST(s AS VARCHAR) AS stream_id, i AS decode_seq, ptype, time FROM r WHERE i >= 0""")
def picture_times(t: Tables) -> DataFrame:
    """Times that pictures take from the queue of packet times; B pictures leave those alone that are shown later than decoded."""
    from ..streaming import pictures

    w, p = Window.partitionBy("stream_id").orderBy("l_orderkey", *_PLACE), F.col("l_partkey")
    rows = t.read("lineitem").withColumn("stream_id", F.floor(F.col("l_orderkey") / 50).cast("bigint").cast("string"))
    rows = rows.select(
        "stream_id", (F.row_number().over(w) - 1).cast("bigint").alias("decode_seq"), F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "P").otherwise("B").alias("ptype"),
        F.when(F.col("l_suppkey") % 4 > 0, p).alias("pts"), F.when(p % 3 == 0, p).when(p % 3 == 1, p - 1).alias("dts"),
    )
    return pictures.with_times(rows, width=64)


@query(f"""WITH {PICTURES}, k AS (SELECT *, min(CASE WHEN ptype = 'I' THEN decode_seq END) OVER (PARTITION BY gop) AS first FROM pictures),
g AS (SELECT *, sum(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS g FROM k WHERE decode_seq >= first)
SELECT gop, decode_seq, row_number() OVER (PARTITION BY gop ORDER BY g, temporal_ref, decode_seq) - 1 AS display_seq FROM g""")
def named_chain(t: Tables) -> DataFrame:
    """Two registered transforms one after the other."""
    return pipeline.chain(t.pictures(), "from_key", "reorder").select("gop", "decode_seq", "display_seq")


@query(f"""WITH {PIXELS}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y / 256.0::DOUBLE - 0.0625::DOUBLE AS y, u / 256.0::DOUBLE - 0.5::DOUBLE AS u, v / 256.0::DOUBLE - 0.5::DOUBLE AS v FROM pixels),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(y * 1.164::DOUBLE + v * 1.596::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS r, greatest(least(y * 1.164::DOUBLE + u * (-0.391)::DOUBLE + v * (-0.813)::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS g,
greatest(least(y * 1.164::DOUBLE + u * 2.018::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS b FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1::DOUBLE - b AS r, 1::DOUBLE - r AS g, 1::DOUBLE - g AS b FROM c""")
def named_effects(t: Tables) -> DataFrame:
    """Registered picture effects with a parameter."""
    out = pipeline.chain(t.pixels(), "to_rgb", ("swizzle", {"mode": 2}), "negative")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r", "g", "b")


@query(f"""WITH {SAMPLES}, a AS (SELECT * FROM samples WHERE stream_id = 'click'), b AS (SELECT * FROM samples WHERE stream_id = 'view')
SELECT seq, a.pts_hns, greatest(least(a.payload + b.payload, 32767), -32768) AS mixed FROM a JOIN b USING (seq)""")
def named_mixer(t: Tables) -> DataFrame:
    """A registered transform with two inputs."""
    s = t.samples()
    return pipeline.apply("mixer", s.where("stream_id = 'click'"), s.where("stream_id = 'view'")).select("seq", "pts_hns", "mixed")


_RGB_SQL = f"""{PIXELS}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y / 256.0::DOUBLE - 0.0625::DOUBLE AS y, u / 256.0::DOUBLE - 0.5::DOUBLE AS u, v / 256.0::DOUBLE - 0.5::DOUBLE AS v FROM pixels),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(least(y * 1.164::DOUBLE + v * 1.596::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS r, greatest(least(y * 1.164::DOUBLE + u * (-0.391)::DOUBLE + v * (-0.813)::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS g,
greatest(least(y * 1.164::DOUBLE + u * 2.018::DOUBLE, 1::DOUBLE), 0::DOUBLE) AS b FROM f)"""


@query(f"""WITH {_RGB_SQL} SELECT 'swapped' AS branch, l_orderkey, l_linenumber, l_partkey, l_suppkey, 1::DOUBLE - b AS r, 1::DOUBLE - r AS g, 1::DOUBLE - g AS b FROM c
UNION ALL SELECT 'plain', l_orderkey, l_linenumber, l_partkey, l_suppkey, 1::DOUBLE - r, 1::DOUBLE - g, 1::DOUBLE - b FROM c""")
def branched_effects(t: Tables) -> DataFrame:
    """One source, which likes to be read as JPEG, converted once and sent through two branches."""
    parts = {
        "colours": graph.Part("to_rgb", ("camera",)),
        "turned": graph.Part("swizzle", ("colours",), {"mode": 2}),
        "swapped": graph.Part("negative", ("turned",)),
        "plain": graph.Part("negative", ("colours",)),
    }
    ends = graph.built(parts, {"camera": graph.Source((graph.JPEG, graph.YUV), lambda kind: t.pixels())})
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r", "g", "b")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("branch"), *columns) for name, df in ends.items()])


@query(f"""WITH {SAMPLES}, a AS (SELECT * FROM samples WHERE stream_id = 'click'), b AS (SELECT * FROM samples WHERE stream_id = 'view'), c AS (SELECT * FROM samples WHERE stream_id = 'signup'),
m AS (SELECT seq, a.pts_hns, greatest(least(a.payload + b.payload, 32767), -32768) AS payload FROM a JOIN b USING (seq))
SELECT seq, m.pts_hns, greatest(least(m.payload + c.payload, 32767), -32768) AS mixed FROM m JOIN c USING (seq)""")
def mixer_graph(t: Tables) -> DataFrame:
    """Three streams through two mixers, one after the other."""
    s = t.samples()
    parts = {"first": graph.Part("mixer", ("click", "view")), "again": graph.Part("as_payload", ("first",)), "out": graph.Part("mixer", ("again", "signup"))}
    sources = {n: graph.Source((graph.PCM16,), lambda kind, n=n: s.where(F.col("stream_id") == n).select("seq", "pts_hns", "payload")) for n in ("click", "view", "signup")}
    return graph.built(parts, sources)["out"].select("seq", "pts_hns", "mixed")
