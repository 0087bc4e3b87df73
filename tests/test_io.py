import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkreel.functions import headers
from sparkreel.sinks import files, images, multipart, wave
from sparkreel.sources import containers, resolver
from sparkreel.streaming import framer, pictures

from .conftest import rows


def tag(kind, ms, body):
    head = bytes([kind]) + len(body).to_bytes(3, "big") + (ms & 0xFFFFFF).to_bytes(3, "big") + bytes([ms >> 24]) + b"\0\0\0"
    return head + body + (11 + len(body)).to_bytes(4, "big")


FLV = b"FLV\x01\x05\x00\x00\x00\x09\0\0\0\0"
MPA = b"\xff\xfd\x10\x00".ljust(104, b"m")  # layer 2, 32 kbit/s, 44.1 kHz
AC3 = b"\x0b\x77\0\0\x00\x40\x40".ljust(128, b"a")  # 32 kbit/s, 48 kHz


def test_flv_tags(spark, tmp_path):
    video = b"\x17\x01\xff\xff\xf6data"
    (tmp_path / "a.flv").write_bytes(FLV + tag(18, 0, b"meta") + tag(9, 40, video) + tag(8, 20, b"\xaf\x01xx") + tag(9, 2**24 + 80, b"\x27\x01\0\0\0") + tag(8, 60, b""))
    out = resolver.open_source(spark, str(tmp_path / "a.flv"))
    got = rows(out, "seq", "stream_id", "size", "pts_hns", "dur_hns", "video.key", "audio.format_name", "error")
    assert got == [
        (0, "script", 4, 0, 0, None, None, None),
        (1, "video", 9, 300_000, 300_000, True, None, None),
        (2, "audio", 4, 200_000, 200_000, None, "aac", None),
        (3, "video", 5, 10000 * (2**24 + 80), 10000 * (2**24 + 80) - 300_000, False, None, None),
        (4, "audio", 0, 600_000, 400_000, None, None, None),
    ]
    assert rows(containers.catalog(out), "stream_id", "samples", "bytes") == [("audio", 2, 4), ("script", 1, 4), ("video", 2, 14)]
    assert out.select("payload").count() == 5 and containers.flv(spark, str(tmp_path), payload=False).where("payload is not null").count() == 0


def test_flv_errors(spark, tmp_path):
    (tmp_path / "cut.flv").write_bytes((FLV + tag(9, 0, b"\x17" * 9))[:-8])
    (tmp_path / "bits.flv").write_bytes(FLV + tag(9 | 0xC0, 0, b"x"))
    (tmp_path / "none.flv").write_bytes(b"nothing")
    got = rows(containers.flv(spark, str(tmp_path)), F.element_at(F.split("path", "/"), -1), "error")
    assert got == [("bits.flv", "reserved bits"), ("cut.flv", "cut tag"), ("none.flv", "no FLV header")]


def test_program_stream(spark, tmp_path):
    pack = b"\0\0\1\xba\x44\0\4\0\4\1\0\0\3\xf8"
    packet = b"\0\0\1\xe0\0\x0c\x80\x80\5" + b"\x21\0\1\0\x0b" + b"body"
    (tmp_path / "a.mpg").write_bytes(b"junk" + pack + packet + b"\0\0\1\xb9tail")
    got = rows(resolver.open_source(spark, str(tmp_path / "a.mpg")), "seq", "at", "code", "kind", "pack.scr", "packet.pts", "packet.payload_size", "error")
    assert got == [(0, 4, 0xBA, None, 0, None, None, None), (1, 18, 0xE0, "video", None, 5, 4, None), (2, 36, 0xB9, "all_video", None, None, None, None)]


@pytest.mark.parametrize(("name", "frame"), [("mpa", MPA), ("ac3", AC3)])
def test_audio_frames(spark, tmp_path, name, frame):
    data = b"id\xff\x0b" + frame * 3 + b"zz" + frame + frame[:50]
    (tmp_path / "x").write_bytes(data)
    got = rows(resolver.open_source(spark, str(tmp_path / "x"), format=name), "at", "size", "header.frame_len", "header.ok", "error")
    n = len(frame)
    assert got == [(4, n, n, True, None), (4 + n, n, n, True, None), (4 + 2 * n, n, n, True, None), (6 + 3 * n, n, n, True, None), (6 + 4 * n, n, n, True, "cut frame")]


def walked(data, kind):
    """The frames of one content, found one by one."""
    out, at = [], data.find(kind.sync)
    while at >= 0:
        size = kind.length(data[at : at + 8])
        if size is None:
            at = data.find(kind.sync, at + 1)
            continue
        cut = at + size > len(data)
        out.append((at, size, data[at : at + 8], data[at : at + size], "cut frame" if cut else None))
        at = -1 if cut else data.find(kind.sync, at + size)
    return out


@pytest.mark.parametrize("window", [1, 50, 1 << 20])
@pytest.mark.parametrize(("kind", "frame"), [(containers.MPA, MPA), (containers.AC3, AC3)])
def test_frames_of_many_contents_equal_a_walk_of_each(monkeypatch, kind, frame, window):
    rng = random.Random(7)
    pieces = [frame, frame[:9], frame[: len(frame) // 2], frame[:20] + frame, kind.sync, kind.sync * 3, b"junk", b"\xff\xfb\x92", b"\x0b"]
    contents = [b"".join(rng.choices([*pieces, rng.randbytes(40)], k=rng.randrange(7))) for _ in range(300)] + [None, b"", frame[:3], frame * 50]
    rng.shuffle(contents)
    batch = pa.record_batch([pa.array(map(str, range(len(contents)))), pa.array(contents, pa.binary())], names=["path", "content"])
    monkeypatch.setattr(containers, "_WINDOW", window)
    columns = ("path", "seq", "at", "size", "head", "payload", "error")
    for part in (batch, batch.slice(37, 101)):
        want = [(name, seq, *rest) for name, content in zip(*part.to_pydict().values()) for seq, rest in enumerate(walked(content or b"", kind))]
        for payload in (True, False):
            found = [tuple(r[c] for c in columns) for b in containers._frame_task(kind, payload)(iter([part])) for r in b.to_pylist()]
            assert len(want) > 90 and found == [(*w[:5], w[5] if payload else None, w[6]) for w in want]


@pytest.mark.parametrize("begin", [b"", b"\xff\xfd"])
def test_built_files_equal_their_contents(spark, begin):
    data = [(None if k == 2 else k, i, None if i == 4 else MPA + b"z" * i) for k in range(6) for i in range(1 + 3 * k % 7)]
    df = spark.createDataFrame(data[::-1], "k bigint, i int, v binary")
    built = containers.Built(df, "k", ("i",), F.col("v"), begin, 3)
    columns = ("path", "seq", "at", "size", "payload", "error")
    found = rows(containers.mpa_rows(built), *columns)
    assert len(found) == sum(v is not None for *_, v in data) and found == rows(containers.mpa_rows(built.contents()), *columns)


@pytest.mark.parametrize("name", ["mpa_files", "ac3_files", "program_files"])
def test_built_files_are_sent_to_python_once(spark, monkeypatch, name):
    from sparkreel.plans import views
    from sparkreel.plans.registry import QUERIES

    monkeypatch.setattr(views, "DEAL", 500)
    folder = "/root/testdata/sf0.001"
    n = views.Tables(spark, folder).read("lineitem").count()
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    # Files are joined and walked by one Python step, in tasks of a bounded number of rows.
    assert plan.count("MapInArrow") == 1 and f", {-(-n // 500)})" in plan


def test_long_fillings(spark):
    from sparkreel.plans.files import _zeros

    found = spark.createDataFrame([(None,), (-1,), (0,), (1,), (512,), (513,), (2000,)], "n bigint").select("n", _zeros(F.col("n")).alias("z")).collect()
    assert [r["z"] and bytes(r["z"]) for r in found[:1]] == [None]
    assert all(bytes(r["z"]) == bytes(max(r["n"], 0)) for r in found[1:])


@pytest.mark.parametrize(("kind", "frame"), [("mpa", MPA), ("ac3", AC3)])
def test_split_at_every_offset(kind, frame):
    data = b"q" + frame * 2
    for cut in range(len(data) + 1):
        first, rest = framer.split(data[:cut], kind)
        second, last = framer.split(rest + data[cut:], kind)
        assert first + second == [frame, frame] and last == b""


def test_streaming_frames_equal_batch(spark, tmp_path):
    data = b"??" + AC3 * 7
    chunks = [("s", i, bytearray(data[i * 100 : i * 100 + 100])) for i in range(10)]
    for i, chunk in enumerate(chunks):
        spark.createDataFrame([chunk], "stream_id string, seq long, data binary").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("stream_id string, seq long, data binary").option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = framer.framed(stream, "ac3").writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(spark.table("frames"), "frame_no", "data")
    assert got == [(i, AC3) for i in range(7)]


def test_many_streams_share_a_key(spark):
    from sparkreel.streaming import replay

    n = 30
    chunks = spark.createDataFrame([(f"s{s}" if s else None, i, bytearray((b"?" * s + AC3 * 3)[i * 100 : i * 100 + 100])) for s in range(n) for i in range(5)], "stream_id string, seq long, data binary")
    parts = [chunks.where("seq < 2"), chunks.where("seq >= 2")]
    found = replay.to_end(framer.framed(replay.replayed(parts, ["stream_id"], 2), "ac3", keys=2))
    assert rows(found) == [(f"s{s}" if s else None, i, AC3) for s in sorted(range(n), key=lambda s: f"s{s}" if s else "") for i in range(3)]
    kinds, temporal = "IPBBPBBI", [0, 3, 1, 2, 6, 4, 5, 0]
    films = spark.createDataFrame([(f"s{s}" if s else None, i, t, k) for s in range(n) for i, (k, t) in enumerate(zip(kinds, temporal))], "stream_id string, decode_seq long, temporal_ref long, ptype string")
    parts = [films.where("decode_seq < 3"), films.where("decode_seq >= 3")]
    shown = replay.to_end(pictures.reordered(replay.replayed(parts, ["stream_id"], 2), window=3, keys=2))
    order = [0, 2, 3, 1, 5, 6, 4]
    assert sorted(((r.stream_id or "", r.display_seq, r.decode_seq) for r in shown.collect())) == sorted((f"s{s}" if s else "", i, d) for s in range(n) for i, d in enumerate(order))


def test_streaming_reorder(spark, tmp_path):
    kinds, temporal = list("IPBBPBBI"), [0, 3, 1, 2, 6, 4, 5, 0]
    data = [("s", i, t, k) for i, (k, t) in enumerate(zip(kinds, temporal))]
    for i, part in enumerate((data[:3], data[3:])):
        spark.createDataFrame(part, "stream_id string, decode_seq long, temporal_ref long, ptype string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("stream_id string, decode_seq long, temporal_ref long, ptype string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = pictures.reordered(stream).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("shown"), "display_seq", "decode_seq") == list(enumerate([0, 2, 3, 1, 5, 6, 4]))


def test_picture_times(spark):
    data = [("s", 0, "I", 100, None), ("s", 1, "P", 400, 150), ("s", 2, "B", 200, 160), ("s", 3, "B", None, None), ("s", 4, "P", None, None)]
    df = spark.createDataFrame(data, "stream_id string, decode_seq long, ptype string, pts long, dts long")
    assert rows(pictures.with_times(df), "decode_seq", "time") == [(0, 100), (1, 400), (2, None), (3, None), (4, 200)]


def test_bitmap(spark):
    pixels = bytearray(bytes(range(12)))
    df = spark.createDataFrame([(pixels, 2, 2), (pixels, 3, 2)], "p binary, w int, h int")
    good, bad = [r[0] for r in df.select(images.bmp(F.col("p"), F.col("w"), F.col("h"))).collect()]
    want = b"BM" + (70).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + b"\1\0\x18\0" + bytes(4) + (16).to_bytes(4, "little") + bytes(16)
    assert bytes(good) == want + bytes(range(6, 12)) + b"\0\0" + bytes(range(6)) + b"\0\0" and bad is None


def test_wave_parts_make_a_file(spark):
    df = spark.createDataFrame([("s", 0, bytearray(b"abcd")), ("s", 1, bytearray(b"ef"))], "k string, n long, d binary")
    parts = rows(wave.parts(df, ["k"], "n", "d", 1, 8000, 16), "n", "bytes")
    whole = b"".join(bytes(p) for _, p in parts)
    head = spark.createDataFrame([(bytearray(whole),)], "d binary").select(headers.riff(F.col("d"))).first()[0]
    assert (head["channels"], head["rate"], head["byte_rate"], head["bits"], head["ok"]) == (1, 8000, 16000, 16, True) and whole[40:] == b"\6\0\0\0abcdef"


def test_wave_source(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, bytearray(b"\0" * 16000))], "k string, n long, d binary")
    (tmp_path / "a.wav").write_bytes(b"".join(bytes(p) for _, p in rows(wave.parts(df, ["k"], "n", "d", 1, 8000, 16), "n", "bytes")))
    assert resolver.open_source(spark, str(tmp_path / "a.wav")).select("size", "dur_hns").first() == (16000, 10_000_000)


def test_named_files(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([(i, bytearray(bytes([i]))) for i in range(5)], "seq int, content binary").select(images.file_name(F.col("seq")).alias("name"), "content")
    df.write.format("namedfiles").mode("append").save(str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"image{i}.bmp": bytes([i]) for i in range(5)}


def test_multipart(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"x" * 70000),), (None,)], "d binary")
    empty, long, none = [r[0] for r in df.select(multipart.part(F.col("d"))).collect()]
    assert bytes(empty) == b"Content-Type: image/jpeg\r\nContent-Length: 0\r\n\r\n\r\n--frame\r\n" and b"Content-Length: 70000\r\n" in bytes(long) and none is None


def test_resolver_and_clock(spark):
    assert [resolver.format_of(x) for x in ("a.FLV", "b.vob", "c.mp2")] == ["flv", "mpegps", "mpa"]
    with pytest.raises(ValueError):
        resolver.format_of("a.txt")
    assert rows(resolver.open_source(spark, "screen:", rows=3), "pts_hns") == [(0,), (1_000_000,), (2_000_000,)]


def test_after_sei():
    unit = lambda kind, n: (n + 1).to_bytes(4, "big") + bytes([kind]) + b"p" * n
    picture = unit(0x65, 9)
    assert containers.after_sei(unit(6, 300) + unit(0x06, 2) + picture) == picture
    assert containers.after_sei(picture) == picture and containers.after_sei(b"\0\0") == b"\0\0" and containers.after_sei(unit(6, 3)) == b""


def test_byte_ranges(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(100)))
    for start, want in ((0, b"\0\1\2"), (97, b"abc"), (99, b"c"), (-2, b"bc"), (-500, b"\0\1\2"), (500, b"")):
        assert containers.ranges(spark, str(tmp_path), start, 3).select("size", "data").first() == (100, want)


def test_release_waits_for_the_clock(spark, tmp_path):
    from datetime import datetime, timedelta

    from sparkreel.streaming import release

    start = datetime(2024, 1, 1)
    batches = [[("s", 0, 5), ("s", 1, 2)], [("s", 2, 20), ("s", 3, 3)], [("s", 4, 21)], [("s", 5, 90)]]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame([(k, n, start + timedelta(seconds=t)) for k, n, t in batch], "stream_id string, seq long, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("stream_id string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = release.released(stream).writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = rows(spark.table("gone"), "pts_ms", "seq", "late_ms")
    assert got[0][1] == 1 and got == sorted(got)
    assert {n for _, n, _ in got} >= {0, 1, 2, 3, 4} and all(late >= 0 for *_, late in got)


def test_zip_of_streams_in_any_order(spark):
    import random

    from sparkreel.streaming import pairs, replay

    draw = random.Random(3)
    sides = [[(i, first, i * 10 + first, None if i % 7 == 3 else i) for i in range(n)] for first, n in ((True, 40), (False, 25))]
    mixed = sides[0] + sides[1]
    draw.shuffle(mixed)
    schema = "seq long, first boolean, pts_hns long, payload long"
    parts = [spark.createDataFrame(mixed[i::3], schema) for i in range(3)]
    want = [(i, i * 10 + 1, None if i % 7 == 3 else i, None if i % 7 == 3 else i) for i in range(25)]
    assert rows(replay.to_end(pairs.zipped(replay.replayed(parts, ["seq"], 2), keys=3))) == want
    with pytest.raises(Exception, match="wait for the other stream"):
        replay.to_end(pairs.zipped(replay.replayed(parts[:1], ["seq"], 2), keys=1, most=5))


def test_epochs_are_left_behind(spark):
    from sparkreel.streaming import pairs, replay

    parts = [[("a", 1, 0), ("a", 2, 1), ("b", 3, 5)], [("a", 4, 0), ("b", 5, 6), ("a", 6, 1)], [("b", 7, 5), ("a", 8, 3)]]
    stream = replay.replayed([spark.createDataFrame(p, "k string, n long, epoch long") for p in parts], ["k"], 1)
    assert rows(replay.to_end(pairs.current(stream, "k"))) == [("a", 2, 1), ("a", 6, 1), ("a", 8, 3), ("b", 3, 5), ("b", 5, 6)]


def test_a_batch_that_is_done_again_counts_once(spark, tmp_path):
    from sparkreel.sinks import batches

    folder, row = str(tmp_path / "out"), lambda name, data: {"name": name, "content": data}
    writer = batches._Stream(folder)
    first = [writer.write([row("a", b"xy"), row("b", None)]), writer.write([]), None]
    writer.commit(first, 0)
    # The stream was restarted before it knew of the commit, and does the batch again.
    writer.commit([writer.write([row("a", b"xy")]), writer.write([row("b", None)])], 0)
    # Another batch fails, and is done again.
    writer.abort([writer.write([row("c", b"half")])], 1)
    writer.commit([writer.write([row("c", b"whole"), row("a", b"again")])], 1)
    got = rows(batches.listed(spark, folder), "batch", "name", "size")
    assert got == [("0" * 20, "a", 2), ("0" * 20, "b", 0), ("0" * 19 + "1", "a", 5), ("0" * 19 + "1", "c", 5)]
    paths = [r["path"] for r in batches.listed(spark, folder).collect()]
    assert sorted(open(p, "rb").read() for p in paths) == [b"", b"again", b"whole", b"xy"]
    assert sorted(str(p) for p in (tmp_path / "out/parts").glob("*/*")) == sorted(paths)


def test_file_batches_of_streams_and_tables(spark, tmp_path):
    from sparkreel.sinks import batches
    from sparkreel.streaming import replay

    batches.register(spark)
    parts = [spark.createDataFrame([(f"f{i}", bytes([i]) * i) for i in range(a, a + 5)], "name string, content binary") for a in (0, 5)]
    for _ in range(2):
        stream = replay.replayed(parts, ["name"], 2) if not (tmp_path / "state").exists() else stream
        stream.writeStream.format("filebatches").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
        assert rows(batches.listed(spark, str(tmp_path / "out")), "name", "size") == [(f"f{i}", i) for i in range(10)]
    parts[0].write.format("filebatches").mode("append").save(str(tmp_path / "table"))
    assert rows(batches.listed(spark, str(tmp_path / "table")), "name", "size") == [(f"f{i}", i) for i in range(5)]


@pytest.mark.parametrize("width", [3, 8, 1000])
def test_picture_times_in_blocks(spark, width):
    import random

    draw, data, want = random.Random(width), [], []
    habits = {"mixed": (0.8, 0.5, 0.4), "backlog": (1.0, 1.0, 0.7), "starved": (0.3, 0.5, 0.4), "plain": (0.9, 0.0, 0.5), None: (0.7, 0.6, 0.6)}
    for stream, (stamped, late, b) in habits.items():
        kinds, stamps = [], []
        for i in range(70):
            kinds.append("B" if draw.random() < b else draw.choice("IP"))
            pts = i * 10
            stamps.append((pts, draw.choice([pts - 1, pts - 2]) if draw.random() < late else draw.choice([pts, None])) if draw.random() < stamped else None)
        data += [(stream, i * 2 - 30, k, *(s or (None, draw.choice([None, 5])))) for i, (k, s) in enumerate(zip(kinds, stamps, strict=True))]
        want += [(stream, i * 2 - 30, k, t) for i, (k, t) in enumerate(zip(kinds, pictures.take_times(kinds, stamps), strict=True))]
    df = spark.createDataFrame(data, "stream_id string, decode_seq long, ptype string, pts long, dts long").withColumn("block", F.lit("x")).repartition(3)
    assert rows(pictures.with_times(df, width)) == rows(spark.createDataFrame(want, "stream_id string, decode_seq long, ptype string, time long"))
    assert pictures.with_times(df.limit(0), width).count() == 0


@pytest.mark.parametrize("group", [1, 3])
def test_picture_times_in_runs_of_blocks(spark, group):
    import random

    draw, data, want = random.Random(group), [], []
    for stream, (stamped, late, b) in {"mixed": (0.8, 0.5, 0.4), "backlog": (1.0, 1.0, 0.7), "starved": (0.3, 0.5, 0.4), None: (0.7, 0.6, 0.6), "early": (1.0, 0.9, 0.9)}.items():
        kinds = ["B" if draw.random() < b else "P" for _ in range(60)]
        stamps = [(i * 10, i * 10 - (draw.random() < late)) if draw.random() < stamped else None for i in range(60)]
        data += [(stream, i * 3 - 30, k, *(s or (None, None))) for i, (k, s) in enumerate(zip(kinds, stamps, strict=True))]
        want += [(stream, i * 3 - 30, k, t) for i, (k, t) in enumerate(zip(kinds, pictures.take_times(kinds, stamps), strict=True))]
    df = spark.createDataFrame(data, "stream_id string, decode_seq long, ptype string, pts long, dts long").repartition(3)
    assert rows(pictures.with_times(df, 4, group)) == rows(spark.createDataFrame(want, "stream_id string, decode_seq long, ptype string, time long"))


def test_short_streams_have_one_round(spark, monkeypatch):
    kept = pictures._stored
    names = []
    monkeypatch.setattr(pictures, "_stored", lambda df, name: names.append(name) or kept(df, name))
    data = [(f"s{k}", i, "BP"[i % 2], i * 10, i * 10 - (i % 3 == 0)) for k in range(5) for i in range(200)]
    df = spark.createDataFrame(data, "stream_id string, decode_seq long, ptype string, pts long, dts long")
    stamps = [(i * 10, i * 10 - (i % 3 == 0)) for i in range(200)]
    want = pictures.take_times(["BP"[i % 2] for i in range(200)], stamps)
    got = pictures.with_times(df, width=64).select("stream_id", "decode_seq", "time").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [(f"s{k}", i, want[i]) for k in range(5) for i in range(200)]
    assert names.count("starts") == 2


def test_a_page_of_samples_is_read_and_written_once():
    import pandas as pd

    from sparkreel.streaming import pairs

    class Map(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def getValue(self, key):
            self.calls += 1
            return self[key]

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    zipping = pairs.Zip(1000, 100)
    zipping.waiting, zipping.count = Map(), Value()
    frame = lambda first, a, b: pd.DataFrame([(i, first, i * 10 + first, None if i == 7 else i) for i in range(a, b)], columns=["seq", "first", "pts_hns", "payload"])
    found = [list(zipping.handleInputRows((0,), iter(frames), None)) for frames in ([frame(True, 0, 150)], [frame(False, 120, 300), frame(False, 0, 50)])]
    assert found[0] == [] and zipping.count.get() == (70 + 150,)
    got = [tuple(None if pd.isna(v) else int(v) for v in r) for f in found[1] for r in f.itertuples(index=False)]
    assert sorted(got) == [(i, i * 10 + 1, None if i == 7 else i, None if i == 7 else i) for i in [*range(50), *range(120, 150)]]
    assert zipping.waiting.calls < 20


def test_packed_batches_have_few_files_and_short_manifests(spark, tmp_path):
    from sparkreel.sinks import batches

    batches.register(spark)
    data = [(f"f{i}" if i % 7 else None, bytes([i]) * (i % 5)) for i in range(100)] + [("large", b"x" * 5000), ("none", None)]
    folder = str(tmp_path / "out")
    spark.createDataFrame(data, "name string, content binary").repartition(2).write.format("filebatches").option("pack", 64).mode("append").save(folder)
    want = sorted((n or "", c or b"") for n, c in data)
    assert sorted((r["name"] or "", bytes(r["content"])) for r in batches.contents(spark, folder).collect()) == want
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out/manifests").glob("run-*")) <= 3
    sizes = [p.stat().st_size for p in (tmp_path / "out/parts").glob("*/*")]
    assert len(sizes) < 12 and sorted(sizes)[-2] <= 64
