from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreel.functions import bits, clock, headers, pixel

from .conftest import rows


def one(spark, column, **values):
    """A column's value over one row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def clock_bytes(value, mark=0x21):
    return bytes([mark | (value >> 30 & 7) << 1, value >> 22 & 255, (value >> 14 & 254) | 1, value >> 7 & 255, (value << 1 & 254) | 1])


def test_clock33_round_trip(spark):
    for value in (0, 1, 2**32 - 1, 2**32, 2**33 - 1):
        assert one(spark, bits.clock33(F.col("d"), 0), d=bytearray(clock_bytes(value))) == value


def test_words_past_the_end_are_null(spark):
    d = bytearray(b"\xff\xfe")
    assert one(spark, bits.be(F.col("d"), 0, 2), d=d) == 0xFFFE
    assert one(spark, bits.be(F.col("d"), 1, 2), d=d) is None


def test_flv_file_header(spark):
    def head(data):
        return one(spark, headers.flv_file(F.col("d")), d=bytearray(data)).asDict()

    good = b"FLV\x01\x05\x00\x00\x00\x09"
    assert head(good) == {"version": 1, "has_audio": True, "has_video": True, "offset": 9, "ok": True}
    for bad in (b"FLW" + good[3:], b"FLV\x02" + good[4:], good[:8] + b"\x0a", b""):
        assert head(bad)["ok"] is False


def test_pes_header_stamps_and_errors(spark):
    def head(flags, body, size=40, first=0x80):
        return one(spark, headers.pes_header(F.col("d")), d=bytearray(b"\x00\x00\x01\xe3" + size.to_bytes(2, "big") + bytes([first, flags, len(body)]) + body)).asDict()

    both = clock_bytes(2**33 - 1, 0x31) + clock_bytes(90000, 0x11)
    x = head(0xC0, both)
    assert (x["kind"], x["number"], x["pts"], x["dts"], x["payload_at"], x["payload_size"], x["error"]) == ("video", 3, 2**33 - 1, 90000, 19, 27, None)
    assert head(0x80, clock_bytes(5))["dts"] is None and head(0x00, b"")["pts"] is None
    assert [head(f, b"\0" * 12)["error"] for f in (0x40, 0x20, 0x01)] == ["stamps", "unsupported field", "unsupported field"]
    assert head(0, b"", first=0x90)["error"] == "scrambled" and head(0, b"", first=0x00)["error"] == "marker"


def test_version_1_packet_stuffing(spark):
    def head(stuffing, middle=b""):
        data = b"\x00\x00\x01\xc0\x00\x30" + b"\xff" * stuffing + middle + clock_bytes(77) + b"data"
        return one(spark, headers.packet1_header(F.col("d")), d=bytearray(data)).asDict()

    for n in (0, 1, 15):
        x = head(n, b"\x40\x20")
        assert (x["pts"], x["payload_at"], x["error"]) == (77, 6 + n + 2 + 5, None)


def test_system_header_entries(spark):
    entries = b"\xe0\xe0\xe6\xc0\xc0\x20"
    data = b"\x00\x00\x01\xbb" + (6 + len(entries)).to_bytes(2, "big") + b"\x80\x00\x01\x04\xe1\xff" + entries
    x = one(spark, headers.system_header(F.col("d")), d=bytearray(data))
    assert [(s["id"], s["kind"], s["number"], s["bound"]) for s in x["streams"]] == [(0xE0, "video", 0, 230 * 1024), (0xC0, "audio", 0, 32 * 128)]
    assert one(spark, headers.system_header(F.col("d")), d=bytearray(data[:12])[:4] + b"\x00\x06" + data[6:12])["streams"] == []


def test_audio_headers(spark):
    x = one(spark, headers.mpa_header(F.col("d")), d=bytearray(b"\xff\xfd\x80\x00"))
    assert (x["layer"], x["kbps"], x["rate"], x["channels"], x["frame_len"], x["ok"]) == (2, 128, 44100, 2, 417, True)
    for bad in (b"\xff\xfd\xf0\x00", b"\xff\xfd\x8c\x00", b"\xff\xf9\x80\x00", b"\x00\x00\x00\x00", b"\xff"):
        assert one(spark, headers.mpa_header(F.col("d")), d=bytearray(bad))["ok"] is False
    x = one(spark, headers.ac3_header(F.col("d")), d=bytearray(b"\x0b\x77\x00\x00\x54\x40\xe1"))
    assert (x["rate"], x["bit_rate"], x["channels"], x["lfe"], x["frame_len"], x["ok"]) == (44100, 192000, 5, 1, 834, True)


def test_riff_and_comparison(spark):
    def wave(channels=2, rate=44100, bits_=16, form=1):
        block = channels * bits_ // 8
        return bytearray(b"RIFF\x24\0\0\0WAVEfmt " + b"".join(x.to_bytes(n, "little") for x, n in ((16, 4), (form, 2), (channels, 2), (rate, 4), (rate * block, 4), (block, 2), (bits_, 2))) + b"data\0\0\0\0")

    same = headers.same_wave(headers.riff(F.col("a")), headers.riff(F.col("b")))
    assert one(spark, same, a=wave(), b=wave()) is True
    for other in (wave(channels=1), wave(rate=8000), wave(bits_=8), wave(form=3), bytearray(b"RIFX"), bytearray()):
        assert one(spark, same, a=wave(), b=other) is False


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-40000, 40000), st.integers(-40000, 40000)), min_size=1, max_size=30))
def test_mix_is_bounded_and_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int")
    for a, b, x, y in df.select("a", "b", pixel.mix16(F.col("a"), F.col("b")), pixel.mix16(F.col("b"), F.col("a"))).collect():
        assert x == y == max(-32768, min(32767, a + b))


def test_centered_and_reference_mix(spark):
    df = spark.createDataFrame([(0, 0), (128, 128), (255, 255), (200, 100)], "a int, b int")
    assert rows(df, "a", "b", pixel.mix8(F.col("a"), F.col("b")), pixel.mix8(F.col("a"), F.col("b"), "reference")) == [(0, 0, 0, 0), (128, 128, 128, 127), (200, 100, 172, 127), (255, 255, 255, 127)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=20))
def test_planes_round_trip(spark, values):
    plane = values + values
    df = spark.createDataFrame([(plane,)], "p array<int>")
    u, v = pixel.deinterleave(F.col("p"))
    both, twice = df.select(pixel.interleave(u, v), pixel.flip_rows(pixel.flip_rows(F.col("p"), 2), 2)).first()
    assert both == plane and twice == plane


def test_arrays_of_other_length_do_not_mix(spark):
    df = spark.createDataFrame([([1, 2], [3]), ([30000, -30000], [30000, -30000])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(pixel.mix_arrays(F.col("a"), F.col("b"))).collect()] == [None, [32767, -32768]]


def test_spoken_time(spark):
    df = spark.createDataFrame([(0,), (36_000_000_000,), (3_599_999_9999,), (100 * 36_000_000_000 + 12_340_000,)], "t long")
    assert [r[0] for r in df.select(clock.spoken(F.col("t"))).collect()] == ["00:00:00.000", "01:00:00.000", "00:59:59.999", "100:00:01.234"]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(10, 0)], "a long, b long")
    assert df.select(clock.of_bytes(F.col("a"), F.col("b")), clock.of_frame(F.col("b"), F.col("a"))).first() == (None, None)


def test_sets_and_headers_are_compiled_and_whole(spark):
    from sparkreel.functions import headers

    unit = lambda *n: b"".join((len(x)).to_bytes(2, "big") + x for x in n)
    head = b"\x17\0\0\0\0\1\x42\0\x1e\xff"
    tags = {
        "one": head + b"\xe1" + unit(b"gA") + b"\1" + unit(b"hB"), "three": head + b"\xe3" + unit(b"gA", b"gBB", b"gC") + b"\2" + unit(b"hD", b"hE"),
        "none": head + b"\xe0\1" + unit(b"hB"), "cut": head + b"\xe1\0\x09gA", "short": head, "other": b"\x27\1" + head, "empty": b"", "null": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in tags.items()], "k string, d binary")
    got = {r["k"]: r["x"] and [r["x"][c] and bytes(r["x"][c]) for c in ("sps", "pps", "record")] for r in df.select("k", headers.avc_config(F.col("d")).alias("x")).collect()}
    assert got == {
        "one": [b"gA", b"hB", b"\0\0\1gA\0\0\1hB"], "three": [b"gA", b"hD", b"\0\0\1gA\0\0\1hD"], "none": [None, b"hB", None], "cut": [None] * 3, "short": [None] * 3, "other": None, "empty": None, "null": None,
    }
    for column in (headers.found_sequence_header(F.col("d")), headers.mpa_header(F.col("d"))):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "RLIKE" not in plan and "regexp" not in plan
    found = spark.createDataFrame([(b"\x30\0\0\1\xb3\x16\x01\x20\x13\0\0\x20\0",), (b"\0\0\x01\x00\xb3",), (b"",), (None,), (b"\xff\0\0\1\xb3",)], "d binary")
    assert [r[0] and (r[0]["at"], r[0]["header"]["width"]) for r in found.select(headers.found_sequence_header(F.col("d"))).collect()] == [(1, 0x160), None, None, None, (1, None)]
