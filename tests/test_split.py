import random

import pytest
from pyspark.sql import functions as F

from sparkreel.sources import containers, split, walk

from .conftest import rows


def tag(kind, ms, data):
    return bytes([kind]) + len(data).to_bytes(3, "big") + (ms & 0xFFFFFF).to_bytes(3, "big") + bytes([ms >> 24]) + b"\0\0\0" + data


def flv(tags):
    out = b"FLV\1\5\0\0\0\x09"
    before = 0
    for t in tags:
        out += before.to_bytes(4, "big") + t
        before = len(t)
    return out + before.to_bytes(4, "big")


def pack(scr):
    return b"\0\0\1\xba" + bytes([0x44 | scr >> 27 & 3]) + b"\0\4\0\4\1\0\0\3\xf8"


def packet(code, pts, body):
    stamp = bytes([0x21 | pts >> 29 & 14]) + (((pts >> 15 & 0x7FFF) << 1) | 1).to_bytes(2, "big") + (((pts & 0x7FFF) << 1) | 1).to_bytes(2, "big")
    data = b"\x80\x80\5" + stamp + body
    return b"\0\0\1" + bytes([code]) + len(data).to_bytes(2, "big") + data


def films(seed):
    """Names and bytes of files whose payloads look like containers themselves."""
    draw = random.Random(seed)
    noise = lambda n: bytes(draw.randrange(256) for _ in range(n))
    inner = flv([tag(draw.choice([8, 9, 18]), i * 10, noise(draw.randrange(30))) for i in range(40)])
    tags = [tag(draw.choice([8, 9, 18]), i * 40, draw.choice([noise(draw.randrange(60)), b"", inner, b"\0" * 50, inner[9:]])) for i in range(60)]
    whole = flv(tags)
    nested = b"".join(pack(i) + packet(0xC0, i, b"x" * draw.randrange(20)) for i in range(30))
    bodies = [noise(30), b"", nested, b"\0\0\1\xba\x44", nested[7:]]
    program = b"junk" + b"".join(draw.choice([pack(i), packet(draw.choice([0xC0, 0xE0, 0xBD]), 90 * i, draw.choice(bodies)), b"\xff" * draw.randrange(5)]) for i in range(120))
    return {"flv": {"whole": whole, "cut": whole[:-11], "bits": whole[:400] + b"\xc8" * 20 + whole[400:], "none": b"nothing", "empty": b"", "short": b"FLV\1\5\0\0\0\x09"},
            "mpegps": {"whole": program, "ended": program + b"\0\0\1\xb9" + nested, "cut": program[:-3], "none": b"\0\0", "empty": b""}}


@pytest.mark.parametrize("kind", ["flv", "mpegps"])
@pytest.mark.parametrize("width", [150, 5000])
def test_ranges_give_what_one_walk_gives(spark, tmp_path, kind, width):
    files = {f"{seed}-{name}": data for seed in range(2) for name, data in films(seed)[kind].items()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = split.records(spark, str(tmp_path), kind, width=width).withColumn("path", F.element_at(F.split("path", "/"), -1))
    want = []
    for name, data in files.items():
        # Spark does not list empty files.
        for seq, (at, code, size, stamp, head, body, error) in enumerate(walk.CONTAINERS[kind].whole(walk.Held(data)) if data else ()):
            want.append((name, seq, at, code, size, stamp, bytearray(head), bytearray(body), error))
    assert rows(got) == rows(spark.createDataFrame(want, split.SCHEMA))
    if width == 150:
        assert got.rdd.getNumPartitions() > len(files)


def test_small_ranges_share_tasks(spark, tmp_path):
    # No size stands after its tag, so no range has a guess, and each goes on where the one before ended.
    tags = [tag(9, i, b"\x27\1\0\0\0" + b"x" * 50) for i in range(900)]
    (tmp_path / "a.flv").write_bytes(b"FLV\1\5\0\0\0\x09" + b"".join(b"\0\0\0\0" + t for t in tags))
    got = split.records(spark, str(tmp_path), "flv", payload=False, width=150)
    assert got.rdd.getNumPartitions() <= 64
    assert rows(got, "seq", "at", "error") == [(i, 9 + 70 * i, None) for i in range(900)]


def test_records_of_small_contents_share_batches():
    import pyarrow as pa

    contents = [flv([tag(8, i, b"\xaf\1")]) for i in range(100)]
    batch = pa.record_batch({"path": [str(i) for i in range(100)], "content": pa.array(contents, pa.binary())})
    found = list(containers._walk_task(containers.flv_tags, True)(iter([batch])))
    assert [b.num_rows for b in found] == [100]
    large = pa.record_batch({"path": ["a"], "content": pa.array([flv([tag(9, i, b"\x17" * (3 << 20)) for i in range(4)])], pa.binary())})
    assert [b.num_rows for b in containers._walk_task(containers.flv_tags, True)(iter([large]))] == [3, 1]


def test_filters_leave_payloads_on_the_disk(spark, tmp_path):
    data = flv([tag(8 + i % 2, i, b"\xaf\1" * 50_000) for i in range(20)])
    (tmp_path / "a.flv").write_bytes(data)
    some = split.records(spark, str(tmp_path), "flv", width=300_000).where("code = 9")
    assert rows(some.select("seq", F.length("payload"))) == [(i, 100_000) for i in range(1, 20, 2)]
    container, span = walk.Flv, split.Span(str(tmp_path / "a.flv"), len(data), -1, 0)
    read = {}
    for name, codes, payload in (("all", None, True), ("video", frozenset([9]), True), ("heads", None, False)):
        with split.Ranged(span.path) as source:
            found = [b for b in split.rows_of(source, container, span, lambda c, k=codes, p=payload: p and (k is None or c in k), codes, payload)]
            read[name] = source.bytes_read
        assert sum(b.num_rows for b in found) == (10 if codes else 20)
    assert read["all"] > 2_000_000 and read["video"] < 1_150_000 and read["heads"] < 20 * 2 * 4096


def test_pushed_filter_is_in_the_reader(spark):
    from pyspark.sql.datasource import EqualTo, In

    reader = split._Reader({"container": "flv", "spans": "[]"})
    asked = [In(("code",), (8, 9)), EqualTo(("code",), 9), EqualTo(("size",), 9)]
    assert list(reader.pushFilters(asked)) == asked and reader.codes == {9}


def test_payload_false_reads_heads_alone(spark, tmp_path):
    (tmp_path / "a.flv").write_bytes(flv([tag(9, i, b"\x17\1\0\0\5" + b"x" * 1000) for i in range(30)]))
    got = containers.flv(spark, str(tmp_path), payload=False, width=4000)
    assert rows(got, "seq", "size", "pts_hns", "video.key", "payload") == [(i, 1005, 10000 * (i + 5), True, None) for i in range(30)]


@pytest.mark.parametrize("kind", ["flv", "mpegps"])
def test_durations_from_both_ends(spark, tmp_path, kind):
    draw, read = random.Random(4), {}
    for n in (40, 4000):
        times = [draw.randrange(10**6) for _ in range(n)]
        if kind == "flv":
            data, codes = flv([tag(8 + i % 2, t, b"\x17\1\0\0\3" + b"y" * 500) for i, t in enumerate(times)]), (8, 9)
            want = lambda i, t: 10_000 * (t + (3 if i % 2 else 0))
        else:
            data, codes = b"".join(pack(0) + packet(0xC0 + 32 * (i % 2), t, b"y" * 500) for i, t in enumerate(times)), (0xC0, 0xE0)
            want = lambda i, t: t * 10_000 // 90
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "f").write_bytes(data)
        got = split.durations(spark, str(tmp_path / str(n)), kind, {*codes, 0xBD})
        ends = [(codes[i], want(i, times[i]), want(i, times[n - 2 + i])) for i in (0, 1)]
        assert rows(got, "code", "first_pts", "last_pts", "dur_hns") == [(c, a, b, b - a) for c, a, b in ends]
        read[n] = rows(split.durations(spark, str(tmp_path / str(n)), kind, set(codes)), "bytes_read")[0][0]
    assert read[4000] < 200_000 and read[4000] < read[40] + 100_000


def test_durations_of_cut_and_foreign_files(spark, tmp_path):
    whole = flv([tag(8, i, b"\xaf\1" * 9) for i in range(50)])
    for name, data in (("cut", whole[:-20]), ("none", b"nothing"), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    assert rows(split.durations(spark, str(tmp_path), "flv", {8}), "first_pts", "last_pts") == [(0, 480_000)]


def test_ranges_read_what_they_return(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 1_000_000)
    assert split.ranges(spark, str(tmp_path), -4, 100).select("size", F.col("data").cast("string"), "bytes_read").first() == (3_000_000, "cabc", 4)
