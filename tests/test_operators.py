import random

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import framing, multi, routing, state, timeline
from sparkreel.plans import pipeline

from .conftest import rows


def test_numbering_in_blocks_equals_plain_numbering(spark):
    draw = random.Random(1)
    data = [(draw.choice("ab"), i * draw.randint(1, 3)) for i in range(1, 200)]
    data = sorted(set(data))
    df = spark.createDataFrame(data, "k string, t long")
    for width in (1, 7, 10**6):
        got = rows(timeline.numbered(df, ["k"], "t", width=width), "k", "t", "seq")
        want = [(k, t, i) for key in "ab" for i, (k, t) in enumerate(sorted(x for x in data if x[0] == key))]
        assert got == sorted(want)


def test_prefix_sum_with_null_keys_and_negative_order(spark):
    df = spark.createDataFrame([(None, -5, 2), (None, 3, 4), ("a", -1, None), ("a", 9, 7)], "k string, t long, v long")
    assert rows(timeline.prefix_sum(df, ["k"], "t", F.col("v"), "s", width=4), "k", "t", "s") == [(None, -5, 0), (None, 3, 2), ("a", -1, 0), ("a", 9, 0)]


def test_gap_fill(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, 100), ("s", 3, None), ("s", 4, None), ("s", 5, 90), ("s", 6, None)], "k string, n int, pts long")
    assert [r[2] for r in rows(timeline.gap_fill(df, ["k"], "n", "pts", F.lit(10)), "k", "n", "filled")] == [None, 100, 110, 120, 90, 100]


def held_back(kinds, temporal):
    """Display order by the one-slot rule: the next expected picture passes, any other waits in the slot."""
    out, slot, expected, fresh = [], None, 0, False
    for i, (kind, t) in enumerate(zip(kinds, temporal)):
        if kind == "I":
            if slot is not None:
                out.append(slot[0])
            slot, expected = None, 0
        if t == expected:
            out.append(i)
            expected += 1
        else:
            if slot is not None and slot[1] == expected:
                out.append(slot[0])
                expected += 1
            slot = (i, t)
    return out + ([slot[0]] if slot else [])


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_display_order_equals_the_slot_rule(spark, m):
    kinds, temporal = [], []
    for _ in range(3):
        kinds.append("I")
        temporal.append(0)
        for k in range(3):
            anchor = (k + 1) * m
            kinds.append("P")
            temporal.append(anchor)
            kinds += ["B"] * (m - 1)
            temporal += range(anchor - m + 1, anchor)
    df = spark.createDataFrame([("g", i, k, t) for i, (k, t) in enumerate(zip(kinds, temporal))], "gop string, decode_seq long, ptype string, temporal_ref long")
    got = [r[1] for r in rows(timeline.display_order(df, ["gop"], "decode_seq", "ptype", "temporal_ref"), "display_seq", "decode_seq")]
    assert got == held_back(kinds, temporal)


def test_references(spark):
    df = spark.createDataFrame([("g", i, k) for i, k in enumerate("IPBBPB")], "gop string, d long, ptype string")
    got = rows(timeline.references(df, ["gop"], "d", "ptype", "d"), "d", "forward", "backward")
    assert got == [(0, None, None), (1, 0, None), (2, 0, 1), (3, 0, 1), (4, 1, None), (5, 1, 4)]


def test_release_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-26, -25, 0, 75, 76)], "d long")
    assert [r[0] for r in df.select(timeline.release(F.col("d"), F.lit(0), 100)).collect()] == ["present", "poll", "poll", "poll", "wait"]


def test_clock_wrap(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([2**33 - 10, 5, 20, 2**33 - 1, 3])], "k string, n int, p long")
    assert [r[1] for r in rows(timeline.unwrapped(df, ["k"], "n", "p"), "n", "pts_long")] == [2**33 - 10, 2**33 + 5, 2**33 + 20, 2**34 - 1, 2**34 + 3]


def test_sequence_of_an_empty_stream(spark):
    a = spark.createDataFrame([], "pts long, dur long")
    b = spark.createDataFrame([(5, 1)], "pts long, dur long")
    assert rows(multi.sequence(a, b, "pts", F.sum("dur"))) == [(5, 1, 2)]


def test_selection_and_negotiation(spark):
    s = spark.createDataFrame([("a", 1, bytearray(b"x")), ("b", 2, bytearray(b"y")), ("c", 3, None)], "stream_id string, n int, payload binary")
    c = spark.createDataFrame([("a", True), ("b", False)], "stream_id string, selected boolean")
    assert rows(routing.select_streams(s, c), "stream_id") == [("a",)]
    assert rows(routing.without_payload(s, c), "stream_id", F.col("payload").isNull()) == [("a", False), ("b", True), ("c", True)]
    assert spark.range(1).select(routing.negotiate(F.array(F.lit("p"), F.lit("q")), F.array(F.lit("q"))), routing.negotiate(F.array(F.lit("p")), F.array(F.lit("q")))).first() == ("q", None)


def test_marker_places(spark):
    df = spark.createDataFrame([(bytearray(b"\0\0\1\xb3ab\0\0\1\xff\0\0\1"),), (bytearray(b""),), (bytearray(b"\0\0\0\1"),), (None,)], "d binary")
    assert [r[0] for r in df.select(framing.marker_places(F.col("d"), b"\0\0\1")).collect()] == [[0, 6, 10], [], [1], []]
    assert rows(framing.start_codes(df.withColumn("k", F.lit(1)).limit(1), "d", ["k"]), "at", "code") == [(0, 0xB3), (6, 0xFF), (10, None)]


def test_first_sync(spark):
    df = spark.createDataFrame([(bytearray(b"\xf0\xb7\x70\x0b\x77"),), (bytearray(b"\x0b\x77"),), (bytearray(b"\x00"),)], "d binary")
    assert [r[0] for r in df.select(framing.first_sync(F.col("d"), "0B77")).collect()] == [3, 0, None]


def test_state_machine(spark):
    log = spark.createDataFrame([(1, 1, "open"), (1, 2, "start"), (1, 3, "open"), (2, 1, "start")], "k int, n int, state string")
    legal = spark.createDataFrame([("start", "open"), ("open", "start")], "from_state string, to_state string")
    assert [r[2] for r in rows(state.checked(log, ["k"], "n", "state", legal), "k", "n", "ok")] == [True, True, True, False]
    assert rows(state.ended(log, ["k"], "state", F.col("n") > 1), "k", "pending", "ended") == [(1, 0, True), (2, 1, False)]


def test_registered_transforms(spark):
    df = spark.createDataFrame([("g", 0, "B", 0), ("g", 1, "I", 0), ("g", 2, "P", 2), ("g", 3, "B", 1)], "gop string, decode_seq long, ptype string, temporal_ref long")
    out = pipeline.chain(df, "from_key", ("reorder", {"keys": ("gop",)}))
    assert rows(out, "display_seq", "decode_seq") == [(0, 1), (1, 3), (2, 2)]
    with pytest.raises(ValueError):
        pipeline.apply("mixer", df)
    with pytest.raises(ValueError, match="no r, g, b"):
        pipeline.apply("negative", df)
    assert {"negative", "swizzle"} <= set(pipeline.names("video effect")) and "mixer" in pipeline.names()


def test_last_known_across_blocks(spark):
    draw = [(s, n, n % 7 == 3 and n or None) for s in ("a", None) for n in (0, 1, 2, 3, 5, 9, 10, 11, 24, 25, 31, 40, 59, 60)]
    df = spark.createDataFrame(draw, "s string, n long, v long")
    for before in (False, True):
        got = {(s, n): x for s, n, _, x in rows(timeline.last_known(df, ["s"], "n", F.col("v"), "x", before, width=10))}
        for s, n, _ in draw:
            known = [v for t, m, v in draw if t == s and v is not None and (m < n or m == n and not before)]
            assert got[s, n] == (known[-1] if known else None)
    assert rows(timeline.last_known(df.limit(0), ["s"], "n", F.col("v"), "x")) == []


def test_durations_and_fills_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([(n, n * n if n % 4 else None) for n in range(50)], "n long, pts long")
    for width in (1, 7, 1000):
        durations = dict(rows(timeline.lag_duration(df, [], "n", "pts", width=width), "n", "dur_hns"))
        assert all(durations[n] == (None if n % 4 == 0 else n * n - (0 if n % 4 == 1 else (n - 1) ** 2)) for n in range(50))
        filled = dict(rows(timeline.gap_fill(df, [], "n", "pts", F.lit(5), width=width), "n", "filled"))
        assert all(filled[n] == (n * n if n % 4 else None if n == 0 else (n - 1) ** 2 + 5) for n in range(50))


# State machines


@pytest.mark.parametrize(("n", "width", "group"), [(3000, 7, 5), (3000, 100_000, 1000), (1, 10, 2)])
def test_a_machine_in_blocks_is_the_machine_in_a_row(spark, n, width, group):
    from sparkreel.operators import machine

    draw = random.Random(n + width)
    for rules, words in ((machine.SESSION, ["play", "pause", "stop", "close", "open", "other", None]), (machine.VIDEO, ["sequence", "gop", "picture", "slice", "extension", "user", "end", "other"])):
        log = [(draw.choice(["one", "one", "one", None, "two"]), i * 3 - 500, draw.choice(words), i) for i in range(n)]
        want, state = [], {}
        for key, place, event, x in log:
            before = state.get(key, rules.start)
            after = rules.moves.get((before, event), rules.otherwise.get(before, before))
            want.append((key, place, event, x, before, after, (before, event) in rules.moves))
            state[key] = after
        df = spark.createDataFrame(log, "key string, place long, event string, map long").repartition(3)
        got = machine.run(df, ["key"], "place", "event", rules, width, group)
        assert rows(got) == rows(spark.createDataFrame(want, got.schema))
    assert machine.run(df.limit(0), ["key"], "place", "event", machine.VIDEO).count() == 0


def test_short_blocks_of_a_machine_share_tasks_and_batches(spark):
    from sparkreel.operators import machine

    log = spark.range(200).selectExpr("id % 3 AS key", "id AS place", "element_at(array('play', 'pause', 'stop', 'close', 'open'), cast(id * 7 % 5 + 1 as int)) AS event")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = machine.run(log, ["key"], "place", "event", machine.SESSION, 10, 2)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        assert rows(got) == rows(machine.run(log, ["key"], "place", "event", machine.SESSION))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Graphs of parts


def test_graphs_agree_on_kinds():
    from sparkreel.plans import graph
    from sparkreel.plans.graph import JPEG, PCM8, PCM16, RGB, YUV, Part

    mixed = {"out": Part("mixer", ("a", "b"))}
    assert graph.agreed(mixed, {"a": (PCM16, PCM8), "b": (PCM8,)}) == {"a": PCM8, "b": PCM8, "out": PCM8}
    with pytest.raises(ValueError, match="out does not take audio/pcm16 with audio/pcm8"):
        graph.agreed(mixed, {"a": (PCM16,), "b": (PCM8,)})
    effects = {"rgb": Part("to_rgb", ("in",)), "one": Part("negative", ("rgb",)), "two": Part("gray", ("rgb",))}
    assert graph.agreed(effects, {"in": (JPEG, YUV)})["two"] == RGB
    with pytest.raises(ValueError, match="rgb does not take in: video/jpeg"):
        graph.agreed(effects, {"in": (JPEG,)})
    with pytest.raises(ValueError, match="x waits for y; y waits for x"):
        graph.ordered({"x": Part("negative", ("y",)), "y": Part("negative", ("x",))}, set())
    with pytest.raises(ValueError, match="is a source and a part"):
        graph.ordered({"x": Part("negative", ("x",))}, {"x"})
    with pytest.raises(ValueError, match="1 inputs, mixer takes 2"):
        graph.agreed({"x": Part("mixer", ("a",))}, {"a": (PCM16,)})


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_joined_runs_over_batches(spark, most):
    data = [(None if k == 2 else k, i, None if i % 5 == 4 else bytes([k, i])) for k in range(6) for i in range(1 + 3 * k % 7)]
    df = spark.createDataFrame(data[::-1], "k int, i int, v binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        found = framing.joined_runs(df, ["k"], ["i"], F.col("v")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {k: b"".join(v for key, _, v in data if key == k and v) for k, _, _ in data}
    assert len(found) == len(want) and {r["k"]: bytes(r["joined"]) for r in found} == want


def test_files_are_not_shuffled_as_bytes(spark):
    from sparkreel.plans import files
    from sparkreel.plans.views import Tables

    plan = files.ac3_contents(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Exchange" in plan


def test_pictures_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from sparkreel.plans import views

    monkeypatch.setattr(views, "DEAL", 500)
    tables = views.Tables(spark, "/root/testdata/sf0.001")
    n = tables.read("lineitem").count()
    shown = timeline.display_order(tables.pictures(), ["gop"], "decode_seq", "ptype", "temporal_ref")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    # One shuffle, into as many parts as the rows need, serves every window.
    assert plan.count("Exchange") == 1 and f"{-(-n // 500)})" in plan.split("Exchange", 1)[1].split("\n")[0]
    assert shown.count() == n
