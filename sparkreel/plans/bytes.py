"""Queries of bit fields, headers, code tables and pixel arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import clock, headers, pixel
from ..functions import tables as codes
from ..operators import multi
from .registry import query
from .views import BLOCKS, PIXELS, Tables, field, word

_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_K = ", ".join(_KEYS)


@query(f"WITH {BLOCKS} SELECT page_id, {word(0, 2)} AS w16, {word(2, 3)} AS w24, {word(5, 4)} AS w32 FROM blocks")
def be_words(t: Tables) -> DataFrame:
    d = F.col("data")
    return t.blocks().select("page_id", B.be(d, 0, 2).alias("w16"), B.be(d, 2, 3).alias("w24"), B.be(d, 5, 4).alias("w32"))


@query(f"WITH {BLOCKS} SELECT page_id, {field(0, 4, 0, 12)} AS a, {field(0, 4, 12, 12)} AS b, {field(0, 4, 24, 4)} AS c, {field(0, 4, 28, 4)} AS d FROM blocks")
def bit_fields(t: Tables) -> DataFrame:
    w = B.be(F.col("data"), 0, 4)
    return t.blocks().select("page_id", *[B.bits(w, 32, at, n).alias(x) for x, at, n in (("a", 0, 12), ("b", 12, 12), ("c", 24, 4), ("d", 28, 4))])


def _clock(at: int) -> str:
    return f"(((({word(at, 1)} >> 1) & 7) << 30) | (({word(at + 1, 2)} >> 1) << 15) | ({word(at + 3, 2)} >> 1))"


@query(f"WITH {BLOCKS} SELECT page_id, {_clock(0)} AS pts, {_clock(5)} AS dts FROM blocks")
def pts33(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", B.clock33(F.col("data"), 0).alias("pts"), B.clock33(F.col("data"), 5).alias("dts"))


@query(f"""WITH {BLOCKS}, s AS (SELECT page_id, {word(0, 1)} | 160 AS id FROM blocks)
SELECT page_id, id, CASE id WHEN 184 THEN 'all_audio' WHEN 185 THEN 'all_video' WHEN 188 THEN 'reserved' WHEN 189 THEN 'private1' WHEN 190 THEN 'padding' WHEN 191 THEN 'private2' ELSE CASE WHEN id & 224 = 192 THEN 'audio' WHEN id & 240 = 224 THEN 'video' WHEN id & 240 = 240 THEN 'data' END END AS kind,
CASE WHEN id IN (184, 185, 188, 189, 190, 191) THEN 0 WHEN id & 224 = 192 THEN id & 31 WHEN id >= 224 THEN id & 15 END AS number FROM s""")
def stream_id_class(t: Tables) -> DataFrame:
    s = t.blocks().select("page_id", B.be(F.col("data"), 0, 1).bitwiseOR(F.lit(160).cast("bigint")).alias("id"))
    return s.select("page_id", "id", headers.stream_class(F.col("id")).alias("c")).select("page_id", "id", "c.*")


@query(f"WITH {BLOCKS} SELECT page_id, {field(0, 2, 3, 13)} * CASE {field(0, 2, 2, 1)} WHEN 1 THEN 1024 ELSE 128 END AS bound FROM blocks")
def buffer_bound(t: Tables) -> DataFrame:
    w = B.be(F.col("data"), 0, 2)
    return t.blocks().select("page_id", headers.buffer_bound(B.bits(w, 16, 2, 1) == 1, B.bits(w, 16, 3, 13)).alias("bound"))


@query("SELECT p_partkey, (p_size * 13 + 15) // 16 AS mb_width, (p_partkey % 577 + 15) // 16 AS mb_height FROM part")
def mb_dims(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", clock.div(F.col("p_size") * 13 + 15, 16).cast("int").alias("mb_width"), clock.div(F.col("p_partkey") % 577 + 15, 16).alias("mb_height"))


@query("SELECT p_partkey, (CAST(p_size % 2 AS BIGINT) << 15) | (CAST(p_size % 4 AS BIGINT) << 12) | (CAST(p_partkey % 16 AS BIGINT) << 4) | CAST(p_size % 16 AS BIGINT) AS packed FROM part")
def pack_params(t: Tables) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    return t.read("part").select("p_partkey", B.pack((s % 2, 15), (s % 4, 12), (p % 16, 4), (s % 16, 0)).alias("packed"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) // 25 AS dims FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(dims <> lag(dims) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), false) AS resized FROM f""")
def resize_detect(t: Tables) -> DataFrame:
    f = t.read("lineitem").select(*_KEYS, clock.div(F.floor("l_quantity"), 25).alias("dims"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return f.select(*_KEYS, F.coalesce(F.col("dims") != F.lag("dims").over(w), F.lit(False)).alias("resized"))


@query(f"""WITH {BLOCKS} SELECT page_id, {field(0, 1, 0, 4)} AS frame_type, {field(0, 1, 4, 4)} AS codec, CASE {field(0, 1, 4, 4)} WHEN 2 THEN 'h263' WHEN 3 THEN 'screen' WHEN 4 THEN 'vp6' WHEN 5 THEN 'vp6_alpha' WHEN 6 THEN 'screen2' WHEN 7 THEN 'avc' END AS codec_name,
CASE {field(0, 1, 4, 4)} WHEN 7 THEN {word(1, 1)} END AS avc_type, CASE {field(0, 1, 4, 4)} WHEN 7 THEN {word(2, 3)} - CASE WHEN {word(2, 3)} >= 8388608 THEN 16777216 ELSE 0 END END AS composition_ms, CASE {field(0, 1, 4, 4)} WHEN 7 THEN {word(2, 3)} END AS composition_raw, {field(0, 1, 0, 4)} = 1 AS key FROM blocks""")
def flv_video_tag(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.flv_video(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(0, 1, 0, 4)} AS format, CASE {field(0, 1, 0, 4)} WHEN 0 THEN 'pcm' WHEN 1 THEN 'adpcm' WHEN 2 THEN 'mp3' WHEN 3 THEN 'pcm_le' WHEN 10 THEN 'aac' WHEN 11 THEN 'speex' END AS format_name,
CAST([5500, 11000, 22000, 44000][1 + {field(0, 1, 4, 2)}] AS BIGINT) AS nominal_rate, CAST([5512, 11025, 22050, 44100][1 + {field(0, 1, 4, 2)}] AS BIGINT) AS true_rate, ({field(0, 1, 6, 1)} + 1) * 8 AS bits, {field(0, 1, 7, 1)} + 1 AS channels, CASE {field(0, 1, 0, 4)} WHEN 10 THEN {word(1, 1)} END AS aac_type FROM blocks""")
def flv_audio_tag(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.flv_audio(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(0, 2, 0, 5)} AS object_type, CAST([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000][1 + {field(0, 2, 5, 4)}] AS BIGINT) AS rate, {field(0, 2, 9, 4)} AS channels FROM blocks""")
def aac_config(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.aac_config(F.col("data")).alias("x")).select("page_id", "x.*")


_RATE = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}


def _rate(i: int) -> str:
    return f"CAST(CASE {field(4, 4, 28, 4)} " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _RATE.items()) + " END AS BIGINT)"


@query(f"""WITH {BLOCKS} SELECT page_id, {field(4, 4, 0, 12)} AS width, {field(4, 4, 12, 12)} AS height, {field(4, 4, 24, 4)} AS aspect_code, {field(4, 4, 28, 4)} AS rate_code, {_rate(0)} AS rate_num, {_rate(1)} AS rate_den,
{field(8, 4, 0, 18)} * 400 AS bit_rate, {field(8, 4, 19, 10)} AS vbv, {field(8, 4, 18, 1)} = 1 AS ok FROM blocks""")
def sequence_header(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.sequence_header(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(4, 4, 0, 4)} AS extension, {field(4, 4, 4, 8)} AS profile, {field(4, 4, 12, 1)} = 1 AS progressive, {field(4, 4, 13, 2)} AS chroma, {field(4, 4, 15, 2)} AS width_ext, {field(4, 4, 17, 2)} AS height_ext FROM blocks""")
def sequence_extension(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.sequence_extension(F.col("data")).alias("x")).select("page_id", "x.*")


_PT = field(4, 5, 10, 3)


@query(f"""WITH {BLOCKS} SELECT page_id, {field(4, 5, 0, 10)} AS temporal_ref, {_PT} AS coding_type, CASE {_PT} WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'B' END AS ptype, {field(4, 5, 13, 16)} AS delay,
CASE WHEN {_PT} IN (2, 3) THEN {field(4, 5, 29, 1)} END AS full_pel_forward, CASE WHEN {_PT} IN (2, 3) THEN {field(4, 5, 30, 3)} END AS forward_code, CASE WHEN {_PT} = 3 THEN {field(4, 5, 33, 1)} END AS full_pel_backward, CASE WHEN {_PT} = 3 THEN {field(4, 5, 34, 3)} END AS backward_code FROM blocks""")
def picture_header(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.picture_header(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(4, 5, 4, 4)} AS f00, {field(4, 5, 8, 4)} AS f01, {field(4, 5, 12, 4)} AS f10, {field(4, 5, 16, 4)} AS f11, {field(4, 5, 20, 2)} AS dc_precision, {field(4, 5, 22, 2)} AS structure,
{", ".join(f"{field(4, 5, 24 + i, 1)} = 1 AS {n}" for i, n in enumerate(("top_first", "frame_pred_dct", "concealment", "q_scale", "intra_vlc", "alternate_scan", "repeat_first")))} FROM blocks""")
def picture_extension(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.picture_extension(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(4, 4, 0, 1)} = 1 AS "drop", {field(4, 4, 1, 5)} AS hours, {field(4, 4, 6, 6)} AS minutes, {field(4, 4, 13, 6)} AS seconds, {field(4, 4, 19, 6)} AS pictures, {field(4, 4, 25, 1)} = 1 AS closed, {field(4, 4, 26, 1)} = 1 AS broken FROM blocks""")
def gop_header(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.gop_header(F.col("data")).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS} SELECT page_id, {field(0, 1, 0, 1)} = 0 AS key, {field(0, 1, 1, 6)} AS quantizer, {field(0, 1, 7, 1)} = 1 AS separated,
CASE WHEN {field(0, 1, 0, 1)} = 0 THEN CASE {field(0, 1, 7, 1)} WHEN 1 THEN {word(4, 1)} ELSE {word(2, 1)} END END AS rows, CASE WHEN {field(0, 1, 0, 1)} = 0 THEN CASE {field(0, 1, 7, 1)} WHEN 1 THEN {word(5, 1)} ELSE {word(3, 1)} END END AS columns FROM blocks""")
def vp6_header(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.vp6_header(F.col("data")).alias("x")).select("page_id", "x.*")


_TWO, _ONE = f"{field(4, 1, 0, 2)} = 1", f"{field(4, 1, 0, 4)} = 2"


@query(f"""WITH {BLOCKS} SELECT page_id, {_ONE} AS is_mpeg1, CASE WHEN {_TWO} THEN ({field(4, 6, 2, 3)} << 30) | ({field(4, 6, 6, 15)} << 15) | {field(4, 6, 22, 15)} WHEN {_ONE} THEN {_clock(4)} END AS scr, CASE WHEN {_TWO} THEN {field(4, 6, 38, 9)} END AS scr_ext,
CASE WHEN {_TWO} THEN {field(10, 3, 0, 22)} WHEN {_ONE} THEN {field(9, 3, 1, 22)} END AS mux_rate, CASE WHEN {_TWO} THEN {field(13, 1, 5, 3)} WHEN {_ONE} THEN 0 END AS stuffing, {_TWO} OR {_ONE} AS ok FROM blocks""")
def pack_header(t: Tables) -> DataFrame:
    return t.blocks().select("page_id", headers.pack_header(F.col("data")).alias("x")).select("page_id", "x.*")


_ST = field(7, 1, 0, 2)


@query(f"""WITH {BLOCKS} SELECT page_id, {word(4, 2)} AS size, CASE WHEN {_ST} >= 2 THEN {_clock(9)} END AS pts, CASE WHEN {_ST} = 3 THEN {_clock(14)} END AS dts, 9 + {word(8, 1)} AS payload_at, {word(4, 2)} - 3 - {word(8, 1)} AS payload_size,
CASE WHEN {field(6, 1, 0, 2)} <> 2 THEN 'marker' WHEN {field(6, 1, 2, 2)} <> 0 THEN 'scrambled' WHEN {_ST} = 1 THEN 'stamps' WHEN {word(7, 1)} & 63 <> 0 THEN 'unsupported field' END AS error FROM blocks""")
def pes_header(t: Tables) -> DataFrame:
    x = headers.pes_header(F.col("data"))
    return t.blocks().select("page_id", x.alias("x")).select("page_id", *[f"x.{c}" for c in ("size", "pts", "dts", "payload_at", "payload_size", "error")])


def _entry(i: int) -> str:
    at = 12 + 3 * i
    return f"{word(at, 1)} AS id{i}, {field(at + 1, 2, 3, 13)} * CASE {field(at + 1, 2, 2, 1)} WHEN 1 THEN 1024 ELSE 128 END AS bound{i}"


@query(f"""WITH {BLOCKS} SELECT page_id, {field(6, 6, 1, 22)} AS rate_bound, {field(6, 6, 24, 6)} AS audio_bound, {field(6, 6, 30, 1)} = 1 AS fixed, {field(6, 6, 35, 5)} AS video_bound, {_entry(0)}, {_entry(1)} FROM blocks""")
def system_header(t: Tables) -> DataFrame:
    """Headers with two stream entries each."""
    d = F.col("data")
    h = headers.system_header(F.concat(F.substring(d, 1, 4), F.unhex(F.lit("000C")), F.substring(d, 7, 26)))
    entries = [F.get("h.streams", F.lit(i)).getField(x).alias(f"{x}{i}") for i in (0, 1) for x in ("id", "bound")]
    return t.blocks().select("page_id", h.alias("h")).select("page_id", "h.rate_bound", "h.audio_bound", "h.fixed", "h.video_bound", *entries)


@query(f"""WITH {BLOCKS} SELECT page_id, {_clock(10)} AS pts, 15 AS payload_at, {word(4, 2)} - 9 AS payload_size FROM blocks""")
def packet_header(t: Tables) -> DataFrame:
    """Version 1 packets with four stuffing bytes and a time stamp."""
    d = F.col("data")
    mark = F.unhex(F.lpad(F.hex(B.be(d, 10, 1) % 16 + 32), 2, "0"))
    data = F.concat(F.substring(d, 1, 6), F.unhex(F.lit("FFFFFFFF")), mark, F.substring(d, 12, 21))
    h = headers.packet1_header(data)
    return t.blocks().select("page_id", h.alias("h")).select("page_id", "h.pts", F.col("h.payload_at").cast("int").alias("payload_at"), "h.payload_size")


# Code tables


def _list(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


_ALL_RATES = "CASE " + " ".join(f"WHEN version = {v} AND layer = {n} THEN {_list(r)}[1 + rate_index]" for (v, n), r in codes.BIT_RATES.items()) + " END"


@query(f"""WITH p AS (SELECT p_partkey, CAST(1 + p_partkey % 2 AS INT) AS version, CAST(1 + p_size % 3 AS INT) AS layer, CAST(p_partkey % 17 AS INT) AS rate_index FROM part)
SELECT p_partkey, version, layer, rate_index, CASE WHEN rate_index < 15 THEN CAST({_ALL_RATES} AS BIGINT) END AS kbps FROM p""")
def rate_lookup(t: Tables) -> DataFrame:
    p = t.read("part").select("p_partkey", (1 + F.col("p_partkey") % 2).cast("int").alias("version"), (1 + F.col("p_size") % 3).cast("int").alias("layer"), (F.col("p_partkey") % 17).cast("int").alias("rate_index"))
    return multi.lookup(p, codes.bit_rates(t.spark), ["version", "layer", "rate_index"]).select("p_partkey", "version", "layer", "rate_index", "kbps")


@query(f"SELECT p_partkey, CAST({_list(codes.AC3_CHANNELS)}[1 + p_partkey % 8] AS BIGINT) AS channels FROM part")
def channel_lookup(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", codes.at(codes.AC3_CHANNELS, F.col("p_partkey") % 8).alias("channels"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 16 WHEN 4 THEN 221 END AS num, CASE p_partkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 9 WHEN 4 THEN 100 END AS den FROM part""")
def aspect_lookup(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([(c, n, d) for c, (n, d) in codes.ASPECTS.items()], "code bigint, num int, den int")
    return multi.lookup(t.read("part").select("p_partkey", (F.col("p_partkey") % 6).alias("code")), table, ["code"]).select("p_partkey", "num", "den")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS code, CAST(720 AS BIGINT) AS w, CAST(CASE p_size % 2 WHEN 0 THEN 576 ELSE 480 END AS BIGINT) AS h FROM part)
SELECT p_partkey, CASE code WHEN 1 THEN 1 WHEN 2 THEN 4 * h WHEN 3 THEN 16 * h WHEN 4 THEN 221 * h END AS n, CASE code WHEN 1 THEN 1 WHEN 2 THEN 3 * w WHEN 3 THEN 9 * w WHEN 4 THEN 100 * w END AS d FROM p""")
def guessed_aspect(t: Tables) -> DataFrame:
    height = F.when(F.col("p_size") % 2 == 0, 576).otherwise(480).cast("bigint")
    x = headers.guessed_aspect(F.lit(720).cast("bigint"), height, F.col("p_partkey") % 6)
    return t.read("part").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'invalid' WHEN 1 THEN 'opening' WHEN 2 THEN 'stopped' WHEN 3 THEN 'paused' WHEN 4 THEN 'started' ELSE 'shutdown' END AS state FROM events")
def code_names(t: Tables) -> DataFrame:
    names = dict(enumerate(("invalid", "opening", "stopped", "paused", "started", "shutdown")))
    return t.read("events").select("event_id", codes.named(names, F.col("user_id") % 6).alias("state"))




@query(f"""WITH {BLOCKS}, h AS (SELECT page_id, 2 + {field(1, 2, 0, 1)} AS v, 1 + {field(1, 2, 1, 2)} % 3 AS lc, {field(1, 2, 3, 4)} AS i, {field(1, 2, 7, 2)} AS f, {field(1, 2, 9, 1)} AS p, {field(1, 2, 10, 2)} AS mode FROM blocks),
k AS (SELECT page_id, v, 4 - lc AS layer, 4 - v AS version, i AS rate_index, p, mode, [44100, 48000, 32000][1 + f] // CASE v WHEN 3 THEN 1 ELSE 2 END AS rate, i <> 15 AND f <> 3 AS ok FROM h),
r AS (SELECT *, CASE WHEN rate_index < 15 THEN {_ALL_RATES} END AS kbps FROM k)
SELECT page_id, CASE WHEN ok THEN layer END AS layer, CASE WHEN ok THEN CAST(kbps AS BIGINT) END AS kbps, CASE WHEN ok THEN CAST(rate AS BIGINT) END AS rate, CASE WHEN ok THEN CAST(CASE mode WHEN 3 THEN 1 ELSE 2 END AS BIGINT) END AS channels,
CASE WHEN ok AND rate_index <> 0 THEN CAST(CASE layer WHEN 1 THEN (kbps * 12000 // rate + p) * 4 WHEN 2 THEN kbps * 144000 // rate + p ELSE kbps * 144000 // (rate * version) + p END AS BIGINT) END AS frame_len, ok FROM r""")
def frame_len_mpa(t: Tables) -> DataFrame:
    """Headers with sync bits set, of versions 1 and 2 and layers 1 to 3; the other fields from pseudo-random bytes."""
    w = B.be(F.col("data"), 1, 2)
    fields = [(F.lit(0x7FF), 21), (2 + B.bits(w, 16, 0, 1), 19), (1 + B.bits(w, 16, 1, 2) % 3, 17), (F.lit(1), 16), (B.bits(w, 16, 3, 4), 12), (B.bits(w, 16, 7, 2), 10), (B.bits(w, 16, 9, 1), 9), (B.bits(w, 16, 10, 2), 6)]
    data = F.unhex(F.hex(B.pack(*fields)))
    return t.blocks().select("page_id", headers.mpa_header(data).alias("x")).select("page_id", "x.*")


@query(f"""WITH {BLOCKS}, h AS (SELECT page_id, {field(4, 1, 0, 2)} AS rc, {field(4, 1, 2, 6)} AS sc, {field(5, 1, 0, 5)} % 14 AS bsid, {word(6, 1)} AS m FROM blocks),
k AS (SELECT *, {_list(codes.AC3_RATES)}[1 + sc // 2] AS kbps, CASE bsid WHEN 9 THEN 2 WHEN 10 THEN 4 WHEN 11 THEN 8 ELSE 1 END AS half, rc < 3 AND sc < 38 AND bsid < 12 AS ok, m >> 5 AS mode FROM h)
SELECT page_id, CASE WHEN ok THEN CAST([48000, 44100, 32000][1 + rc] // half AS BIGINT) END AS rate, CASE WHEN ok THEN CAST(kbps * 1000 // half AS BIGINT) END AS bit_rate, CASE WHEN ok THEN CAST({_list(codes.AC3_CHANNELS)}[1 + mode] AS BIGINT) END AS channels,
CASE WHEN ok THEN CAST(m & [16, 16, 4, 4, 4, 1, 4, 1][1 + mode] <> 0 AS BIGINT) END AS lfe, CASE WHEN ok THEN CAST(CASE rc WHEN 0 THEN 4 * kbps WHEN 1 THEN 2 * (320 * kbps // 147 + sc % 2) ELSE 6 * kbps END AS BIGINT) END AS frame_len, ok FROM k""")
def frame_len_ac3(t: Tables) -> DataFrame:
    d = F.col("data")
    bsid = B.pack((B.bits(B.be(d, 5, 1), 8, 0, 5) % 14, 3))
    data = F.concat(F.unhex(F.lit("0B77")), F.substring(d, 3, 3), F.unhex(F.lpad(F.hex(bsid), 2, "0")), F.substring(d, 7, 1))
    return t.blocks().select("page_id", headers.ac3_header(data).alias("x")).select("page_id", "x.*")


# Pixels


def _c(x: str, low: str = "0", high: str = "255") -> str:
    return f"greatest(least({x}, {high}), {low})"


@query(f"""WITH {PIXELS} SELECT {_K}, {_c("(19077 * (y - 16) + 26355 * (v - 128)) >> 14")} AS r, {_c("(19077 * (y - 16) - 6657 * (u - 128) - 13424 * (v - 128)) >> 14")} AS g, {_c("(19077 * (y - 16) + 33311 * (u - 128)) >> 14")} AS b FROM pixels""")
def yuv_rgb_int(t: Tables) -> DataFrame:
    return t.pixels().select(*_KEYS, *[x.alias(k) for k, x in pixel.rgb_int(F.col("y"), F.col("u"), F.col("v")).items()])


_Y, _U, _V = "(y / 256.0::DOUBLE - 0.0625::DOUBLE)", "(u / 256.0::DOUBLE - 0.5::DOUBLE)", "(v / 256.0::DOUBLE - 0.5::DOUBLE)"


def _d(x: float) -> str:
    return f"{x}::DOUBLE"


_RGB = f"""rgb AS (SELECT {_K}, greatest(least({_Y} * {_d(1.164)} + {_V} * {_d(1.596)}, 1::DOUBLE), 0::DOUBLE) AS r,
greatest(least({_Y} * {_d(1.164)} + {_U} * ({_d(-0.391)}) + {_V} * ({_d(-0.813)}), 1::DOUBLE), 0::DOUBLE) AS g,
greatest(least({_Y} * {_d(1.164)} + {_U} * {_d(2.018)}, 1::DOUBLE), 0::DOUBLE) AS b FROM pixels)"""


def _floats(sql: dict[str, str]) -> str:
    # Six places, as whole numbers: the same on both sides.
    shown = ", ".join(f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT) AS {k}" for k, x in sql.items())
    return f"WITH {PIXELS}, {_RGB} SELECT {_K}, {shown} FROM rgb"


def _shown(t: Tables, **columns) -> DataFrame:
    return t.pixels().select(*_KEYS, *[F.floor(x * 1_000_000 + 0.5).cast("bigint").alias(k) for k, x in columns.items()])


def _rgb() -> dict:
    return pixel.rgb_float(F.col("y"), F.col("u"), F.col("v"))


@query(_floats({"r": "r", "g": "g", "b": "b"}))
def yuv_rgb_float(t: Tables) -> DataFrame:
    return _shown(t, **_rgb())


@query(_floats({"r": "1.0::DOUBLE - r", "g": "1.0::DOUBLE - g", "b": "1.0::DOUBLE - b"}))
def negative(t: Tables) -> DataFrame:
    return _shown(t, **pixel.negative(_rgb()))


@query(_floats({"r1": "r", "g1": "b", "b1": "g", "r2": "b", "g2": "r", "b2": "g", "r3": "b", "g3": "g", "b3": "r"}))
def swizzle(t: Tables) -> DataFrame:
    return _shown(t, **{f"{k}{mode}": x for mode in (1, 2, 3) for k, x in pixel.swizzle(_rgb(), mode).items()})


@query(_floats({"gray": "(r + g + b) / 3.0::DOUBLE"}))
def gray_mean(t: Tables) -> DataFrame:
    return _shown(t, gray=pixel.mean(_rgb()))


_LUMA = f"r * {_d(0.3)} + g * {_d(0.59)} + b * {_d(0.11)}"


@query(_floats({"gray": _LUMA}))
def gray_luma(t: Tables) -> DataFrame:
    return _shown(t, gray=pixel.luma(_rgb()))


@query(_floats({k: f"pow({k}, {_d(1.5)})" for k in "rgb"}))
def contrast_pow(t: Tables) -> DataFrame:
    return _shown(t, **pixel.contrast(_rgb(), 1.5))


@query(_floats({k: f"({_LUMA}) + ({k} - ({_LUMA})) * {_d(0.5)}" for k in "rgb"}))
def saturation_lerp(t: Tables) -> DataFrame:
    return _shown(t, **pixel.saturation(_rgb(), 0.5))


@query(f"WITH {PIXELS} SELECT {_K}, 256 - 1 - y AS x, 256 - 1 - u AS y FROM pixels")
def mirror(t: Tables) -> DataFrame:
    return t.pixels().select(*_KEYS, pixel.mirror(F.col("y"), 256).alias("x"), pixel.mirror(F.col("u"), 256).alias("y"))


@query(f"WITH {PIXELS} SELECT {_K}, greatest(least((y * u * v - 3000000 + 128) >> 8, 32767), -32768) AS s FROM pixels")
def round_clamp(t: Tables) -> DataFrame:
    return t.pixels().select(*_KEYS, pixel.round_clamp16(F.col("y") * F.col("u") * F.col("v") - 3_000_000, 8).alias("s"))


@query(f"""WITH {PIXELS}, n AS (SELECT *, lead(y) OVER w AS next FROM pixels WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT {_K}, (y + next + 1) >> 1 AS half, (y + next + u + v + 2) >> 2 AS quarter FROM n""")
def avg2_neighbours(t: Tables) -> DataFrame:
    after = F.lead("y").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    p = t.pixels().withColumn("next", after)
    return p.select(*_KEYS, pixel.average(F.col("y"), F.col("next")).alias("half"), pixel.average(F.col("y"), F.col("next"), F.col("u"), F.col("v")).alias("quarter"))


@query(f"WITH {PIXELS} SELECT l_orderkey, CAST((16 * sum(y * y) - sum(y) * sum(y)) // 256 AS BIGINT) AS variance FROM pixels GROUP BY l_orderkey")
def block_variance(t: Tables) -> DataFrame:
    y = F.col("y")
    return t.pixels().groupBy("l_orderkey").agg(clock.div(16 * F.sum(y * y) - F.sum(y) * F.sum(y), 256).alias("variance"))


@query("""WITH c AS (SELECT l_orderkey, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 0) AS BIGINT) AS l, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 2), 0) AS BIGINT) AS r, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 3), 0) AS BIGINT) AS c, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber > 3), 0) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(l + r + c + s AS DOUBLE) AS mono, CAST(l + c + s AS DOUBLE) AS left_out, CAST(r + c + s AS DOUBLE) AS right_out FROM c""")
def downmix(t: Tables) -> DataFrame:
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    sums = [F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0)).alias(n) for n, cond in (("l", line == 1), ("r", line == 2), ("c", line == 3), ("s", line > 3))]
    c = t.read("lineitem").groupBy("l_orderkey").agg(*sums)
    args = [F.col(x) for x in "lrcs"]
    (mono,), (left, right) = pixel.downmix(*args, to=1), pixel.downmix(*args, to=2)
    return c.select("l_orderkey", mono.alias("mono"), left.alias("left_out"), right.alias("right_out"))



def _text(x: Column) -> Column:
    return F.array_join(x.cast("array<string>"), ",")


@query("""SELECT doc_id, string_agg(substr(h, i, 2), '' ORDER BY i) FILTER (WHERE i % 4 = 1) AS u, string_agg(substr(h, i, 2), '' ORDER BY i) FILTER (WHERE i % 4 = 3) AS v FROM (SELECT doc_id, md5(text) AS h, unnest(range(1, 33, 2)) AS i FROM documents) GROUP BY doc_id""")
def plane_split(t: Tables) -> DataFrame:
    h = F.md5(F.col("text").cast("binary"))
    plane = F.filter(F.split(F.regexp_replace(h, "(..)", "$1,"), ","), lambda x: x != "")
    u, v = pixel.deinterleave(plane)
    return t.read("documents").select("doc_id", F.array_join(u, "").alias("u"), F.array_join(v, "").alias("v"))


@query("""SELECT doc_id, substr(h, 25, 8) || substr(h, 17, 8) || substr(h, 9, 8) || substr(h, 1, 8) AS flipped, substr(h, 1, 16) || substr(h, 25, 8) || substr(h, 17, 8) AS swapped FROM (SELECT doc_id, md5(text) AS h FROM documents)""")
def row_flip(t: Tables) -> DataFrame:
    """Four rows of four bytes flipped; and of planes of 8, 4 and 4 bytes the last two exchanged."""
    h = F.md5(F.col("text").cast("binary"))
    plane = F.filter(F.split(F.regexp_replace(h, "(..)", "$1,"), ","), lambda x: x != "")
    swapped = F.concat(F.slice(plane, 1, 8), F.slice(plane, 13, 4), F.slice(plane, 9, 4))
    return t.read("documents").select("doc_id", F.array_join(pixel.flip_rows(plane, 4), "").alias("flipped"), F.array_join(swapped, "").alias("swapped"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 AND c_acctbal BETWEEN -100 AND 5000 THEN c_acctbal END AS setting FROM customer")
def range_checked_setting(t: Tables) -> DataFrame:
    return t.read("customer").select("c_custkey", pixel.in_range(F.col("c_acctbal"), F.lit(-100.0), F.lit(5000.0), F.col("c_nationkey") % 5 != 0).alias("setting"))


@query("""WITH v AS (SELECT vec_id, list_transform(range(1, 65), lambda i: greatest(least(CAST(floor(embedding[i]::DOUBLE * 100000) AS BIGINT) + CAST(floor(embedding[65 - i]::DOUBLE * 100000) AS BIGINT), 32767), -32768)) AS m FROM embeddings)
SELECT vec_id, array_to_string(m, ',') AS mixed FROM v""")
def mix_buffers(t: Tables) -> DataFrame:
    a = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100000.0).cast("bigint"))
    return t.read("embeddings").select("vec_id", _text(pixel.mix_arrays(a, F.reverse(a))).alias("mixed"))
