import random

import pytest
from pyspark.sql import functions as F

from sparkreel.sources import growing, walk

from .conftest import rows
from .test_split import films


def run(spark, folder, state, out, kind, **options):
    query = growing.records(spark, str(folder), kind, **options).writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(out)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("kind", ["flv", "mpegps"])
def test_a_resumed_run_gives_each_record_once(spark, tmp_path, kind):
    draw = random.Random(1)
    files = {n: d for n, d in films(5)[kind].items() if d and n not in ("cut", "none", "short")}
    folder = tmp_path / "in"
    folder.mkdir()
    done = {name: 0 for name in files}
    for step in range(4):
        for name, data in files.items():
            if step == 0 and name != "whole":
                continue
            stop = len(data) if step == 3 else min(len(data), done[name] + draw.randrange(len(data) // 2))
            with open(folder / name, "ab") as f:
                f.write(data[done[name] : stop])
            done[name] = stop
        run(spark, folder, tmp_path / "state", tmp_path / "out", kind)
    got = spark.read.parquet(str(tmp_path / "out")).select(F.element_at(F.split("path", "/"), -1), "seq", "at", "code", "size", "payload", "error")
    want = [(name, seq, at, code, size, bytearray(body), error) for name, data in files.items() for seq, (at, code, size, _, _, body, error) in enumerate(walk.CONTAINERS[kind].whole(walk.Held(data))) if not (error or "").startswith("cut")]
    # A record that is cut waits for its rest.
    assert rows(got) == rows(spark.createDataFrame(want, "path string, seq long, at long, code long, size long, payload binary, error string"))


def test_batches_are_bounded(spark, tmp_path):
    data = films(6)["flv"]["whole"]
    (tmp_path / "a.flv").write_bytes(data[:3000])
    seen = []
    query = growing.records(spark, str(tmp_path / "a.flv"), "flv", payload=False, max_bytes=2000).writeStream.foreachBatch(lambda df, n: seen.append(rows(df, "seq", "at", "size"))).option("checkpointLocation", str(tmp_path / "_state")).start()
    try:
        query.processAllAvailable()
        with open(tmp_path / "a.flv", "ab") as f:
            f.write(data[3000:])
        query.processAllAvailable()
    finally:
        query.stop()
    records = list(walk.Flv.whole(walk.Held(data)))
    assert [r for batch in seen for r in batch] == [(i, r[0], r[2]) for i, r in enumerate(records)]
    assert len([b for b in seen if b]) > 5
    assert all(b[-1][1] - b[0][1] < 2000 for b in seen[1:] if b)


def test_foreign_and_missing_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"FL")
    (tmp_path / "b").write_bytes(b"nothing that is FLV")
    for _ in range(2):
        run(spark, tmp_path, tmp_path / "_state", tmp_path / "_out", "flv")
    assert rows(spark.read.parquet(str(tmp_path / "_out")), "at", "error") == [(0, "no FLV header")]
    run(spark, tmp_path / "none", tmp_path / "_s", tmp_path / "_o", "flv")
