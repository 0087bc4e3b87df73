"""Queries of routing, two-input, time and state operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, headers, pixel
from ..operators import framing, machine, multi, routing, state, timeline
from .registry import query
from .views import BLOCKS, PICTURES, SAMPLES, Tables, word

FRAME = 333_667  # 30000/1001 frames a second


# Two inputs


@query(f"""WITH {SAMPLES} SELECT a.seq, a.pts_hns, a.payload AS a, b.payload AS b, greatest(least(a.payload + b.payload, 32767), -32768) AS mixed
FROM samples a JOIN samples b ON a.seq = b.seq WHERE a.stream_id = 'click' AND b.stream_id = 'view'""")
def zip_mix16(t: Tables) -> DataFrame:
    s = t.samples()
    return multi.mix_streams(s.where("stream_id = 'click'"), s.where("stream_id = 'view'"), ["seq"], ["pts_hns"])


@query("""WITH c AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) & 255 AS a FROM customer), s AS (SELECT s_suppkey AS k, CAST(floor(s_acctbal) AS BIGINT) & 255 AS b FROM supplier)
SELECT k AS seq, a, b, greatest(least(a + b - 256, 127), -128) + 128 AS centered, least(a + b, 127) AS reference FROM c JOIN s USING (k)""")
def zip_mix8(t: Tables) -> DataFrame:
    def side(name: str, key: str, value: str) -> DataFrame:
        return t.read(name).select(F.col(key).alias("seq"), F.floor(value).cast("bigint").bitwiseAND(F.lit(255).cast("bigint")).alias("payload"))

    z = multi.zip_streams(side("customer", "c_custkey", "c_acctbal"), side("supplier", "s_suppkey", "s_acctbal"), ["seq"], [])
    return z.select("*", pixel.mix8(F.col("a"), F.col("b")).alias("centered"), pixel.mix8(F.col("a"), F.col("b"), "reference").alias("reference"))


@query(f"""WITH {SAMPLES}, tokens AS (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS seq FROM conversations WHERE role = 'user')
SELECT s.seq, s.event_id, t.conv_id, t.turn FROM samples s JOIN tokens t ON s.seq = t.seq WHERE s.stream_id = 'signup'""")
def zip_requests(t: Tables) -> DataFrame:
    asked = t.read("conversations").where("role = 'user'").select("role", "conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("place"))
    asked = timeline.numbered(asked, ["role"], "place", "seq", width=10**10)
    return multi.answered(t.samples().where("stream_id = 'signup'"), asked, "seq").select("seq", "event_id", "conv_id", "turn")


@query(f"""WITH {SAMPLES} SELECT stream_id, event_id, pts_hns, payload, 1 AS segment FROM samples WHERE stream_id = 'click'
UNION ALL SELECT stream_id, event_id, pts_hns + (SELECT max(pts_hns) - min(pts_hns) FROM samples WHERE stream_id = 'click'), payload, 2 FROM samples WHERE stream_id = 'view'""")
def sequence_concat(t: Tables) -> DataFrame:
    s = t.samples().drop("seq", "user_id")
    return multi.sequence(s.where("stream_id = 'click'"), s.where("stream_id = 'view'"), "pts_hns", F.max("pts_hns") - F.min("pts_hns"))


@query("""SELECT 'audio' AS stream_id, c_custkey AS key, c_acctbal AS level FROM customer UNION ALL SELECT 'video', s_suppkey, s_acctbal FROM supplier""")
def aggregate_union(t: Tables) -> DataFrame:
    audio = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("level"))
    video = t.read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("level"))
    return multi.union_streams(audio=audio, video=video)


@query(f"""WITH {SAMPLES}, index AS (SELECT stream_id, CAST(row_number() OVER (ORDER BY stream_id) - 1 AS BIGINT) AS stream_index FROM (SELECT DISTINCT stream_id FROM samples))
SELECT event_id, stream_id, stream_index FROM samples JOIN index USING (stream_id)""")
def stream_index(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    s = t.samples()
    # One row for each stream: a small catalog.
    index = s.select("stream_id").distinct().withColumn("stream_index", (F.row_number().over(Window.orderBy("stream_id")) - 1).cast("bigint"))
    return multi.lookup(s.select("event_id", "stream_id"), index, ["stream_id"])


# Types


@query("""WITH p AS (SELECT p_partkey, 1 + p_size % 3 AS channels, 8 * (1 + p_size % 3) AS bits, CASE p_size % 2 WHEN 0 THEN 44100 ELSE 16000 END AS rate, p_partkey % 5 AS slip FROM part),
q AS (SELECT *, channels * bits // 8 + CASE slip WHEN 1 THEN 1 ELSE 0 END AS block_align FROM p), r AS (SELECT *, rate * block_align + CASE slip WHEN 2 THEN 1 ELSE 0 END AS byte_rate FROM q)
SELECT p_partkey, channels IN (1, 2) AND bits IN (8, 16) AND block_align = channels * bits // 8 AND byte_rate = rate * block_align AND rate * block_align < 4294967296 AS ok FROM r""")
def pcm_type_check(t: Tables) -> DataFrame:
    p = t.read("part").select("p_partkey", (1 + F.col("p_size") % 3).alias("channels"), (8 * (1 + F.col("p_size") % 3)).alias("bits"), F.when(F.col("p_size") % 2 == 0, 44100).otherwise(16000).alias("rate"), (F.col("p_partkey") % 5).alias("slip"))
    p = p.withColumn("block_align", clock.div(F.col("channels") * F.col("bits"), 8) + (F.col("slip") == 1).cast("bigint"))
    p = p.withColumn("byte_rate", F.col("rate") * F.col("block_align") + (F.col("slip") == 2).cast("bigint"))
    return p.select("p_partkey", headers.pcm_ok(F.col("channels"), F.col("bits"), F.col("rate"), F.col("block_align"), F.col("byte_rate")).alias("ok"))


@query("""WITH o AS (SELECT n_nationkey, n_name, CASE n_nationkey % 4 WHEN 0 THEN ['YUY2', 'NV12'] WHEN 1 THEN ['RGB32'] WHEN 2 THEN ['AYUV'] ELSE ['I420', 'RGB24', 'NV12'] END AS offers FROM nation)
SELECT n_nationkey, n_name, list_filter(offers, lambda x: list_contains(['NV12', 'RGB32', 'RGB24'], x))[1] AS chosen FROM o""")
def type_negotiation(t: Tables) -> DataFrame:
    lists = [["YUY2", "NV12"], ["RGB32"], ["AYUV"], ["I420", "RGB24", "NV12"]]
    offers = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    accepts = F.array(*map(F.lit, ("NV12", "RGB32", "RGB24")))
    return t.read("nation").select("n_nationkey", "n_name", routing.negotiate(offers, accepts).alias("chosen"))


@query("""SELECT a.s_suppkey, (a.s_nationkey, a.s_suppkey % 3) IS NOT DISTINCT FROM (b.s_nationkey, b.s_suppkey % 3) AS same FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 3""")
def type_equal(t: Tables) -> DataFrame:
    s = t.read("supplier").select("s_suppkey", F.struct("s_nationkey", F.col("s_suppkey") % 3).alias("kind"))
    other = s.select((F.col("s_suppkey") - 3).alias("s_suppkey"), F.col("kind").alias("other"))
    return s.join(other, "s_suppkey").select("s_suppkey", routing.same_type(F.col("kind"), F.col("other")).alias("same"))


_SUBTYPES = ("NV12", "YV12", "I420", "RGB24", "RGB32", "AYUV")
_CATALOG_SQL = "catalog AS (SELECT p_partkey, ['NV12', 'YV12', 'I420', 'RGB24', 'RGB32', 'AYUV'][1 + p_partkey % 6] AS subtype, p_size * 16 AS width, (p_partkey % 40) * 16 AS height FROM part)"


def _catalog(t: Tables) -> DataFrame:
    subtype = F.element_at(F.array(*map(F.lit, _SUBTYPES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.read("part").select("p_partkey", subtype.alias("subtype"), (F.col("p_size") * 16).alias("width"), (F.col("p_partkey") % 40 * 16).alias("height"))


@query(f"""WITH {_CATALOG_SQL} SELECT p_partkey, subtype IN ('NV12', 'RGB32') AND width > 0 AND height > 0 AND width <= 1920 AS accepted FROM catalog""")
def type_acceptance(t: Tables) -> DataFrame:
    return _catalog(t).select("p_partkey", routing.accepted(*map(F.col, ("subtype", "width", "height")), ("NV12", "RGB32"), 1920).alias("accepted"))


@query(f"""WITH {_CATALOG_SQL} SELECT p_partkey, CASE WHEN subtype IN ('NV12', 'YV12', 'I420') THEN width * height * 3 // 2 WHEN subtype = 'RGB24' THEN width * height * 3 WHEN subtype = 'RGB32' THEN width * height * 4 END AS frame_bytes FROM catalog""")
def output_type(t: Tables) -> DataFrame:
    return _catalog(t).select("p_partkey", routing.frame_bytes(F.col("subtype"), F.col("width"), F.col("height")).alias("frame_bytes"))


@query(f"""WITH {_CATALOG_SQL} SELECT p_partkey, 'video' AS major, subtype, width, height, width || 'x' || height AS size FROM catalog""")
def media_type(t: Tables) -> DataFrame:
    kind = routing.video_type(*map(F.col, ("subtype", "width", "height")))
    return _catalog(t).select("p_partkey", kind.alias("k")).select("p_partkey", "k.*")


# Routing


@query(f"""WITH {SAMPLES} SELECT stream_id, seq, payload, CASE stream_id WHEN 'click' THEN 'video' ELSE 'audio' END AS target FROM samples WHERE stream_id IN ('click', 'view')""")
def demux_route(t: Tables) -> DataFrame:
    return routing.route(t.samples(), {"click": "video", "view": "audio"}).select("stream_id", "seq", "payload", "target")


_SELECTED = ("click", "signup")
_SELECTION = "('click', 'signup')"


def _selection(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("event_type").alias("stream_id")).distinct().withColumn("selected", F.col("stream_id").isin(*_SELECTED))


@query(f"""WITH {SAMPLES} SELECT stream_id, event_id, seq, payload FROM samples WHERE stream_id IN {_SELECTION}""")
def stream_select(t: Tables) -> DataFrame:
    return routing.select_streams(t.samples(), _selection(t)).select("stream_id", "event_id", "seq", "payload")


@query(f"""WITH {SAMPLES} SELECT event_id, stream_id, CASE WHEN stream_id IN {_SELECTION} THEN payload END AS payload FROM samples""")
def skip_payload(t: Tables) -> DataFrame:
    return routing.without_payload(t.samples(), _selection(t)).select("event_id", "stream_id", "payload")


@query(f"""WITH {SAMPLES} SELECT stream_id, event_id FROM samples WHERE stream_id <> 'error'""")
def drop_script(t: Tables) -> DataFrame:
    return routing.without_streams(t.samples(), "error").select("stream_id", "event_id")


@query(f"""WITH {BLOCKS}, s AS (SELECT page_id, {word(0, 1)} AS id FROM blocks)
SELECT page_id, id FROM s WHERE id BETWEEN 192 AND 239 OR id = 189""")
def stream_whitelist(t: Tables) -> DataFrame:
    from ..functions.bits import be

    b = t.blocks().select("page_id", be(F.col("data"), 0, 1).alias("id"))
    return b.withColumn("kind", headers.stream_class(F.col("id"))["kind"]).where(F.col("kind").isin("video", "audio", "private1")).select("page_id", "id")


@query(f"""WITH {PICTURES}, m AS (SELECT *, max(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS seen FROM pictures)
SELECT gop, decode_seq, ptype FROM m WHERE seen = 1""")
def first_key_gate(t: Tables) -> DataFrame:
    return timeline.after_first_key(t.pictures(), ["gop"], "decode_seq", F.col("ptype") == "I").select("gop", "decode_seq", "ptype")


@query(f"""WITH {SAMPLES}, m AS (SELECT *, last_value(CASE stream_id WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS open FROM samples)
SELECT user_id, event_id, stream_id FROM m WHERE open""")
def sink_gate(t: Tables) -> DataFrame:
    s = t.samples()
    return timeline.intervals_between(s, ["user_id"], "event_id", F.col("stream_id") == "signup", F.col("stream_id") == "error").select("user_id", "event_id", "stream_id")


@query(f"""WITH {SAMPLES}, m AS (SELECT *, count(*) FILTER (WHERE stream_id = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM samples)
SELECT user_id, event_id, epoch FROM m WHERE epoch = (SELECT max(epoch) FROM m x WHERE x.user_id = m.user_id)""")
def epoch_filter(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    sofar = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = t.samples().withColumn("epoch", F.count_if(F.col("stream_id") == "error").over(sofar))
    return routing.latest_epoch(s, ["user_id"], "epoch").select("user_id", "event_id", "epoch")


@query("""SELECT l_orderkey, bool_or(l_linestatus = 'O') AS ok FROM lineitem GROUP BY l_orderkey""")
def selection_valid(t: Tables) -> DataFrame:
    return routing.valid_selection(t.read("lineitem").select("l_orderkey", (F.col("l_linestatus") == "O").alias("selected")), "l_orderkey")


# Time


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * 86400 * 90) * 10000 // 90 AS hns FROM lineitem""")
def hns_from_90k(t: Tables) -> DataFrame:
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clock.from_90k(F.col("l_partkey") * 86400 * 90).alias("hns"))


@query("""SELECT event_id, 10000 * (epoch_us(ts) // 1000 + user_id % 40) AS hns FROM events""")
def hns_from_ms(t: Tables) -> DataFrame:
    ms = clock.div(F.unix_micros(F.col("ts").cast("timestamp")), 1000)
    return t.read("events").select("event_id", clock.from_ms(ms, F.col("user_id") % 40).alias("hns"))


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) * 10000000 // 32000 AS dur_hns FROM documents""")
def dur_from_bytes(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", clock.of_bytes(F.octet_length("text"), 32000).alias("dur_hns"))


@query(f"""WITH {SAMPLES} SELECT stream_id, event_id, CAST(coalesce(sum(payload) OVER (PARTITION BY stream_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM samples""")
def position_prefix(t: Tables) -> DataFrame:
    s = t.samples().select("stream_id", "event_id", "payload")
    return timeline.prefix_sum(s, ["stream_id"], "event_id", F.col("payload"), "start").select("stream_id", "event_id", "start")


@query(f"""WITH {SAMPLES} SELECT event_id, stream_id, pts_hns - coalesce(lag(pts_hns) OVER (PARTITION BY stream_id ORDER BY event_id), 0) AS dur_hns FROM samples""")
def lag_duration(t: Tables) -> DataFrame:
    return timeline.lag_duration(t.samples(), ["stream_id"], "event_id", "pts_hns").select("event_id", "stream_id", "dur_hns")


@query(f"""WITH {SAMPLES} SELECT event_id, user_id, pts_hns - coalesce(lag(pts_hns) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS dur_hns FROM samples""")
def lag_duration_across(t: Tables) -> DataFrame:
    """Durations across all streams of one file; a user's events are one file here."""
    return timeline.lag_duration(t.samples(), ["user_id"], "event_id", "pts_hns").select("event_id", "user_id", "dur_hns")


_SPARSE = "sparse AS (SELECT user_id, event_id, CASE WHEN stream_id = 'click' THEN pts_hns END AS pts FROM samples)"


@query(f"""WITH {SAMPLES}, {_SPARSE}, g AS (SELECT *, count(pts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM sparse)
SELECT user_id, event_id, CASE WHEN g > 0 THEN max(pts) OVER (PARTITION BY user_id, g) + (row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1) * {FRAME} END AS filled FROM g""")
def gap_fill(t: Tables) -> DataFrame:
    s = t.samples().select("user_id", "event_id", F.when(F.col("stream_id") == "click", F.col("pts_hns")).alias("pts"))
    return timeline.gap_fill(s, ["user_id"], "event_id", "pts", F.lit(FRAME)).select("user_id", "event_id", "filled")


@query(f"""WITH {PICTURES}, g AS (SELECT *, sum(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS g FROM pictures)
SELECT gop, decode_seq, CASE WHEN g > 0 THEN max(CASE WHEN ptype = 'I' THEN decode_seq * 1000000 END) OVER (PARTITION BY gop, g) + (row_number() OVER (PARTITION BY gop, g ORDER BY decode_seq) - 1) * {FRAME} END AS pts FROM g""")
def reanchor(t: Tables) -> DataFrame:
    p = t.pictures().withColumn("given", F.when(F.col("ptype") == "I", F.col("decode_seq") * 1_000_000))
    return timeline.gap_fill(p, ["gop"], "decode_seq", "given", F.lit(FRAME), "pts").select("gop", "decode_seq", "pts")


@query(f"""WITH {PICTURES}, g AS (SELECT *, sum(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS g FROM pictures)
SELECT gop, decode_seq, ptype, row_number() OVER (PARTITION BY gop ORDER BY g, temporal_ref, decode_seq) - 1 AS display_seq FROM g""")
def reorder_gop(t: Tables) -> DataFrame:
    return timeline.display_order(t.pictures(), ["gop"], "decode_seq", "ptype", "temporal_ref").select("gop", "decode_seq", "ptype", "display_seq")


@query(f"""WITH {PICTURES}, a AS (SELECT *, last_value(CASE WHEN ptype <> 'B' THEN decode_seq END IGNORE NULLS) OVER (PARTITION BY gop ORDER BY decode_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  count(*) FILTER (WHERE ptype <> 'B') OVER (PARTITION BY gop ORDER BY decode_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
  count(*) FILTER (WHERE ptype <> 'B') OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS own FROM pictures),
anchors AS (SELECT gop, own AS rank, decode_seq AS id FROM a WHERE ptype <> 'B')
SELECT a.gop, a.decode_seq, CASE a.ptype WHEN 'P' THEN a.l WHEN 'B' THEN x.id END AS forward, CASE a.ptype WHEN 'B' THEN a.l END AS backward FROM a LEFT JOIN anchors x ON x.gop = a.gop AND x.rank = a.n - 1""")
def ref_chain(t: Tables) -> DataFrame:
    return timeline.references(t.pictures(), ["gop"], "decode_seq", "ptype", "decode_seq").select("gop", "decode_seq", "forward", "backward")


@query(f"""WITH {SAMPLES}, m AS (SELECT *, count(*) FILTER (WHERE stream_id = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM samples)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id) = 1 AS discontinuity FROM m""")
def discontinuity_flag(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    s = t.samples().withColumn("epoch", F.count_if(F.col("stream_id") == "error").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id", "epoch").orderBy("event_id")) == 1).alias("discontinuity"))


@query(f"""WITH {PICTURES} SELECT gop, decode_seq, ptype = 'I' AS clean_point FROM pictures""")
def clean_point(t: Tables) -> DataFrame:
    return t.pictures().select("gop", "decode_seq", timeline.clean_point(F.col("ptype")).alias("clean_point"))


@query(f"""WITH {SAMPLES}, d AS (SELECT event_id, payload * 37 % 1000000 - 500000 AS early FROM samples) SELECT event_id, CASE WHEN early * 4 < -{FRAME} THEN 'present' WHEN early * 4 > {FRAME} * 3 THEN 'wait' ELSE 'poll' END AS release FROM d""")
def release_class(t: Tables) -> DataFrame:
    s = t.samples().select("event_id", (F.col("payload") * 37 % 1_000_000 - 500_000).alias("early"))
    return s.select("event_id", timeline.release(F.col("early"), F.lit(0), FRAME).alias("release"))


@query(f"""WITH {SAMPLES} SELECT stream_id, event_id, seq + 1 >= 3 AS ready FROM samples""")
def preroll_ready(t: Tables) -> DataFrame:
    return t.samples().select("stream_id", "event_id", timeline.preroll_ready(F.col("seq"), 3).alias("ready"))


@query(f"""WITH {SAMPLES} SELECT stream_id, min_by(pts_hns, event_id) AS first_pts, max_by(pts_hns, event_id) AS last_pts, max_by(pts_hns, event_id) - min_by(pts_hns, event_id) AS dur_hns FROM samples GROUP BY stream_id""")
def stream_duration(t: Tables) -> DataFrame:
    return timeline.stream_span(t.samples(), ["stream_id"], "event_id", "pts_hns")


@query("""SELECT doc_id, n_chars * 8 * 10000000 // (32000 * (1 + doc_id % 8)) AS dur_hns FROM documents""")
def duration_estimate(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", clock.of_file(F.col("n_chars"), 32000 * (1 + F.col("doc_id") % 8)).alias("dur_hns"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * l_suppkey * 997 AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ms // 3600000 < 10 THEN '0' ELSE '' END || (ms // 3600000) || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS shown FROM m""")
def time_format(t: Tables) -> DataFrame:
    hns = F.col("l_partkey") * F.col("l_suppkey") * 997 * 10_000
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clock.spoken(hns).alias("shown"))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 24000, 1001), (2, 24, 1), (3, 25, 1), (4, 30000, 1001), (5, 30, 1), (6, 50, 1), (7, 60000, 1001), (8, 60, 1)) AS r(code, num, den))
SELECT p_partkey, CAST(r.num AS BIGINT) AS num, CAST(r.den AS BIGINT) AS den, CAST(r.den AS BIGINT) * 10000000 // r.num AS frame_hns FROM part LEFT JOIN r ON r.code = p_size % 10""")
def avg_frame_time(t: Tables) -> DataFrame:
    from ..functions import tables as codes

    p = t.read("part").select("p_partkey", (F.col("p_size") % 10).alias("code"))
    return multi.lookup(p, codes.frame_rates(t.spark), ["code"]).select("p_partkey", "num", "den", clock.of_frame(F.col("num"), F.col("den")).alias("frame_hns"))


@query("""WITH c AS (SELECT event_id, user_id, (event_id * 4000000000) % 8589934592 AS pts FROM events), w AS (SELECT *, CASE WHEN lag(pts) OVER (PARTITION BY user_id ORDER BY event_id) - pts > 4294967296 THEN 1 ELSE 0 END AS wrap FROM c)
SELECT event_id, user_id, CAST(pts + sum(wrap) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) * 8589934592 AS BIGINT) AS pts_long FROM w""")
def clock_unwrap(t: Tables) -> DataFrame:
    c = t.read("events").select("event_id", "user_id", (F.col("event_id") * 4_000_000_000 % (1 << 33)).alias("pts"))
    return timeline.unwrapped(c, ["user_id"], "event_id", "pts").select("event_id", "user_id", "pts_long")


# State


@query("""WITH m AS (SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') AS from_state FROM conversations)
SELECT conv_id, turn, from_state, role, (from_state, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS ok FROM m""")
def fsm_transitions(t: Tables) -> DataFrame:
    legal = t.spark.createDataFrame([("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")], "from_state string, to_state string")
    return state.checked(t.read("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", legal).select("conv_id", "turn", "from_state", "role", "ok")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT o_custkey, count(*) FILTER (WHERE NOT done) AS pending, bool_and(done) AS ended FROM s GROUP BY o_custkey""")
def eos_count(t: Tables) -> DataFrame:
    return state.ended(t.read("orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], "o_orderpriority", F.col("o_orderstatus") == "F")


# Folds and framing


@query(f"""WITH {PICTURES}, m AS (SELECT *, CAST(sum(CASE WHEN ptype = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY gop ORDER BY decode_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS picture FROM pictures)
SELECT gop, picture, count(*) AS slices, string_agg(CAST(size AS VARCHAR), ',' ORDER BY decode_seq) AS offsets FROM m WHERE picture > 0 GROUP BY gop, picture""")
def slice_collect(t: Tables) -> DataFrame:
    s = framing.slices(t.pictures(), ["gop"], "decode_seq", F.col("ptype") == "I", "size")
    return s.withColumn("offsets", F.array_join(F.col("offsets").cast("array<string>"), ","))


@query(f"""WITH {PICTURES} SELECT gop, decode_seq, (lead(size * 100 + decode_seq) OVER (PARTITION BY gop ORDER BY decode_seq) - (size * 100 + decode_seq)) * 8 AS bits, (row_number() OVER (PARTITION BY gop ORDER BY decode_seq) - 1) * 45 AS mb_start FROM pictures""")
def slice_geometry(t: Tables) -> DataFrame:
    p = t.pictures().withColumn("offset", F.col("size") * 100 + F.col("decode_seq"))
    return framing.slice_geometry(p, ["gop"], "decode_seq", "offset", 45).select("gop", "decode_seq", "bits", "mb_start")


@query("""SELECT page_id, len(string_split(html, '<p>')) - 1 AS markers FROM pages""")
def startcode_count(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", framing.marker_count(F.col("html").cast("binary"), b"<p>").alias("markers"))


@query("""WITH p AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages), e AS (SELECT page_id, unnest(range(1, len(parts))) AS i, parts FROM p)
SELECT page_id, CAST(octet_length(encode(array_to_string(parts[1:i], '<p>'))) AS BIGINT) AS at FROM e""")
def marker_positions(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.explode(framing.marker_places(F.col("html").cast("binary"), b"<p>")).alias("at"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [0, 1, 2, 179, 181, 184, 178, 183, 200, 3, 4, 0][1 + l_partkey % 12] AS code FROM lineitem),
u AS (SELECT *, CASE WHEN code = 0 THEN 'picture' WHEN code BETWEEN 1 AND 175 THEN 'slice' WHEN code = 179 THEN 'sequence' WHEN code = 181 THEN 'extension' WHEN code = 178 THEN 'user' WHEN code = 183 THEN 'end' WHEN code = 184 THEN 'gop' ELSE 'other' END AS unit FROM c),
b AS (SELECT *, lag(unit) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unit, unit IN ('sequence', 'gop', 'picture') AND (before IS NULL OR before = 'slice') AS begins FROM b""")
def chunk_states(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (0, 1, 2, 179, 181, 184, 178, 183, 200, 3, 4, 0)])
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(codes, (F.col("l_partkey") % 12 + 1).cast("int")).alias("code"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return framing.chunk_states(rows.withColumn("place", F.row_number().over(place).cast("bigint")), ["l_orderkey"], "place").drop("code", "place")


def _machine_sql(moves: dict, otherwise: dict, start: str, rows: str, keys: str, order: str, columns: str) -> str:
    """Rows r(k, n, event) run one after the other through a table of moves."""
    legal = ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in moves.items())
    other = " ".join(f"WHEN '{s}' THEN '{to}'" for s, to in otherwise.items())
    rest = lambda x: f"CASE {x} {other} ELSE {x} END" if other else x
    return f"""WITH RECURSIVE e AS ({rows}), x AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS __n FROM e), m(a, b, c) AS (VALUES {legal}),
r AS (SELECT x.*, '{start}' AS from_state, coalesce(m.c, {rest(f"'{start}'")}) AS to_state, m.c IS NOT NULL AS ok FROM x LEFT JOIN m ON m.a = '{start}' AND m.b = x.event WHERE __n = 1
UNION ALL SELECT x.*, r.to_state, coalesce(m.c, {rest("r.to_state")}), m.c IS NOT NULL FROM r JOIN x ON x.{keys} = r.{keys} AND x.__n = r.__n + 1 LEFT JOIN m ON m.a = r.to_state AND m.b = x.event)
SELECT {columns}, event, from_state, to_state, ok FROM r"""


_COMMANDS = {"click": "play", "view": "pause", "purchase": "stop", "error": "close", "signup": "open"}
_COMMAND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMMANDS.items())


@query(_machine_sql(machine.SESSION.moves, machine.SESSION.otherwise, machine.SESSION.start, f"SELECT user_id, event_id, CASE event_type {_COMMAND_SQL} END AS event FROM events", "user_id", "event_id", "user_id, event_id"))
def session_states(t: Tables) -> DataFrame:
    """States of sessions by the commands they get; blocks are short, so a user's log is in many."""
    command = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _COMMANDS.items()])
    return machine.run(t.read("events").select("user_id", "event_id", command.alias("event")), ["user_id"], "event_id", "event", machine.SESSION, width=1000, group=3)


_UNITS = ("picture", "slice", "slice", "sequence", "extension", "gop", "user", "end", "other", "slice", "slice", "picture")


@query(_machine_sql(machine.VIDEO.moves, machine.VIDEO.otherwise, machine.VIDEO.start, f"SELECT l_orderkey // 20 AS stream, row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place, {list(_UNITS)}[1 + l_partkey % 12] AS event FROM lineitem", "stream", "place", "stream, place"))
def video_states(t: Tables) -> DataFrame:
    """What a video parser waits for at each unit of a stream, and whether the unit is in its place."""
    units = F.array(*[F.lit(u) for u in _UNITS])
    place = Window.partitionBy("stream").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = t.read("lineitem").withColumn("stream", F.floor(F.col("l_orderkey") / 20).cast("bigint"))
    rows = rows.select("stream", F.row_number().over(place).cast("bigint").alias("place"), F.element_at(units, (F.col("l_partkey") % 12 + 1).cast("int")).alias("event"))
    return machine.run(rows, ["stream"], "place", "event", machine.VIDEO, width=16, group=2)


@query("""WITH h AS (SELECT p_partkey, p_size % 2 + 1 AS channels, CASE p_partkey % 3 WHEN 0 THEN 44100 ELSE 48000 END AS rate FROM part)
SELECT a.p_partkey, a.channels = b.channels AND a.rate = b.rate AS same FROM h a JOIN h b ON b.p_partkey = a.p_partkey + 1""")
def wave_compare(t: Tables) -> DataFrame:
    """Headers of neighbouring files, written as bytes and read back."""
    from ..sinks.wave import header

    p = t.read("part").select("p_partkey", F.col("p_size") % 2 == 0, (F.col("p_partkey") % 3 == 0).alias("cd"), (F.col("p_size") % 2 + 1).alias("channels"))
    made = [(c, r, header(F.lit(0), c, r, 16)) for c in (1, 2) for r in (44100, 48000)]
    data = F.coalesce(*[F.when((F.col("channels") == c) & (F.col("cd") == F.lit(r == 44100)), x) for c, r, x in made])
    h = p.select("p_partkey", headers.riff(data).alias("h"))
    other = h.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("h").alias("g"))
    return h.join(other, "p_partkey").select("p_partkey", headers.same_wave(F.col("h"), F.col("g")).alias("same"))


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, hex(encode(text)[5:8]) AS head, hex(encode(text)[-4:]) AS tail FROM documents""")
def byte_ranges(t: Tables) -> DataFrame:
    d = F.col("text").cast("binary")
    return t.read("documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.hex(F.substring(d, 5, 4)).alias("head"), F.hex(F.substring(d, -4, 4)).alias("tail"))


@query("""SELECT conv_id, count(*) AS buffers, string_agg(text, '' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def coalesce_buffers(t: Tables) -> DataFrame:
    return framing.coalesced(t.read("conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query("""SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS buffers FROM documents GROUP BY source""")
def bytes_total(t: Tables) -> DataFrame:
    return state.byte_totals(t.read("documents"), ["source"], "text")


@query("""SELECT s_nationkey, min(least(s_acctbal, 5000.0)) AS level FROM supplier GROUP BY s_nationkey""")
def least_level(t: Tables) -> DataFrame:
    return state.least_level(t.read("supplier"), ["s_nationkey"], "s_acctbal", 5000.0)


@query("""SELECT doc_id, 'Content-Type: image/jpeg' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(text)) || chr(13) || chr(10) || chr(13) || chr(10) || text || chr(13) || chr(10) || '--frame' || chr(13) || chr(10) AS part FROM documents""")
def http_frames(t: Tables) -> DataFrame:
    from ..sinks.multipart import part

    return t.read("documents").select("doc_id", part(F.col("text").cast("binary")).cast("string").alias("part"))


@query("""SELECT page_id, replace(substr(url, 9), '%20', ' ') AS path FROM pages""")
def url_clean(t: Tables) -> DataFrame:
    from ..sources.resolver import local_path

    return t.read("pages").select("page_id", local_path(F.col("url")).alias("path"))
