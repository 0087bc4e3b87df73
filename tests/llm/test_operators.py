import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel.llm import common, decontaminate, kernels, language_id, line_dedup, lm_score, media, mixing, near_dedup, pii, substring_dedup, url_filter
from tests.compare import connect, differences
from tests.conftest import rows

from . import brute

DRAW = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)]


def prose(n, draw=DRAW):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text, n, draw=DRAW):
    w = text.split(" ")
    for _ in range(n):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return " ".join(w)


def corpus():
    draw = random.Random(3)
    base = [prose(draw.randint(30, 200), draw) for _ in range(12)]
    texts = [*base]
    texts += [edited(base[i % 4], draw.randint(1, 12), draw) for i in range(60)]
    texts += [base[5], base[5], base[6] + " " + base[7], "x " * 300, "x " * 301 + "y", "Ab cD", "ab Cd", "one", "", "  \n\t "]
    texts += [f"{prose(40, draw)} {base[8][:300]} {prose(40, draw)}" for _ in range(5)]
    return list(enumerate(texts))


ODD = [(None, None), (None, "a b c d e f"), (1, None), (2, ""), (3, "é ü ß " * 5), (4, "x" * 200_000), (5, "x y " * 20_000), (6, "same words here again"), (6, "same words here again")]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# Kernels


def test_words_and_shingles_of_slices():
    import pyarrow as pa

    texts = ["a b  c\td\n", None, "", "\x0b\x0c", "é\u00a0ü x", "Zz"]
    for limit in (1, 5, 1000):
        got = []
        for w in kernels.words(pa.array(texts), limit=limit):
            for i in range(len(w.rows)):
                got.append([bytes(w.buf[w.starts[j] : w.ends[j]]).decode() for j in range(w.first[i], w.first[i + 1])])
        assert got == [brute.words(t) for t in texts]


def test_sliding_min():
    values = np.array([5, 3, 9, 1, 7, 7, 2, 8], np.uint64)
    for width in range(1, 9):
        assert kernels.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1), (7, 7)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long"))))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.components({x for e in real for x in e}, real)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i + 1, i) for i in range(3000)] + [(10_000, 10_001 + i) for i in range(500)] * 2 + [(20_000 + i, 20_000 + j) for i in range(30) for j in range(i)]
    folder = common.shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = rows(common.components(spark.createDataFrame(edges, "a long, b long")))
    assert len(got) == len(dict(got)) and dict(got) == {i: 0 for i in range(3001)} | {10_000 + i: 10_000 for i in range(501)} | {20_000 + i: 20_000 for i in range(30)}
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("components-")
    assert rows(common.components(spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3)], "a long, b long"))) == []


def test_a_cluster_must_name_the_shared_folder(spark):
    class Session:
        """What shared_folder reads of a session."""

        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})

    assert common.shared_folder(Session("spark://host:7077", "hdfs:///x/")) == "hdfs:///x"
    assert common.shared_folder(Session("local[*]")) == common.shared_folder(Session("local"))
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(Session(master))


# 1 Language-model scores


@pytest.mark.parametrize("block_bytes", [400, 10**9])
def test_backoff(docs, block_bytes):
    data = corpus()
    got = rows(lm_score.backoff_scores(docs(data), block_bytes=block_bytes), "doc_id", "n_words", "score_micros")
    want = sorted(brute.backoff(data, 3, 0.4, 2))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) <= x[1] for x, y in zip(got, want, strict=True))


def test_backoff_edges(spark, docs):
    got = rows(lm_score.backoff_scores(docs(ODD)), "doc_id", "n_words")
    assert got == sorted([(i, len(brute.words(t))) for i, t in ODD], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert rows(lm_score.backoff_scores(empty(spark))) == []


def test_equal_rows_are_dealt_to_different_blocks():
    import pyarrow as pa

    draw = np.random.default_rng(2)
    hashes = np.r_[np.full(300, 5), draw.integers(0, 2**62, 100)]
    dealt = []
    for order in (np.arange(400), draw.permutation(400)):
        batch = pa.record_batch([pa.array(hashes[order] % 1000), pa.array([f"t{h}" for h in hashes[order]]), pa.array(hashes[order])], names=["doc_id", "text", "hash"])
        found = {}
        for out in lm_score._pack_task(10)(iter([batch.slice(0, 150), batch.slice(150)])):
            for block, docs in zip(out.column("block").to_pylist(), out.column("docs"), strict=True):
                found.setdefault(block, []).extend(pa.ipc.open_stream(docs.as_py()).read_all()["text"].to_pylist())
        dealt.append({b: sorted(t) for b, t in found.items()})
    assert dealt[0] == dealt[1]
    assert max(t.count("t5") for t in dealt[0].values()) < 60 and sum(map(len, dealt[0].values())) == 400


def test_packing_round_trips():
    keys = np.array([0, 1, 5, 5, 2**40, 2**48 - 1], np.uint64)
    assert lm_score.unpack_keys(lm_score.pack_keys(keys)).tolist() == keys.tolist()
    assert lm_score.unpack_keys(lm_score.pack_keys(keys[2:3])).tolist() == [5]
    counts = np.array([1, 2, 255, 254, 10**12, 1, 1, 1, 3])
    assert lm_score.unpack_counts(lm_score.pack_counts(counts), len(counts)).tolist() == counts.tolist()


def test_keys_are_whole_hashes():
    import pyarrow as pa

    keys = np.array([0, 1, 2**16, 2**40, 2**63 - 1, 2**63, 2**64 - 2, 2**64 - 1], np.uint64)
    assert lm_score.unpack_keys(lm_score.pack_keys(keys)).tolist() == keys.tolist()
    block = lm_score._Block(pa.chunked_array([["a b a"]]))
    block.hashes = np.array([5 << 16 | 1, 5 << 16 | 2, 5 << 16 | 1], np.uint64)
    _, _, back, keys, counts, _, by = next(block.orders(1, 1))
    assert len(set(lm_score.unpack_keys(lm_score.pack_keys(keys[by])).tolist())) == 3
    assert counts[back].tolist() == [2, 1, 2]


# 2 Line dedup


def test_line_windows(docs):
    block = "a\nb\nc"
    data = [(1, f"p\n{block}\nq"), (2, f"r\n{block}\ns"), (3, "a\n\n b \nc\nt"), (4, "\n".join(["z"] * 6)), (5, "a\nb"), (6, "a\nb"), (7, None), (8, ""), (9, f"{block}\nq\nnew"), (10, "c\nb\na")]
    got = rows(line_dedup.dedup_lines(docs(data)), "doc_id", "text")
    assert got == brute.lines_removed(data, 3)
    assert dict(got)[2] == "r\ns" and dict(got)[3] == "t" and dict(got)[4] == "z" and dict(got)[9] == "new"


def test_line_dedup_edges(spark, docs):
    got = line_dedup.dedup_lines(docs(ODD + [(9, "a\nb\nc"), (9, "a\nb\nc"), (None, "a\nb\nc")]), keep=("source",))
    assert got.count() == len(ODD) + 3 and got.where("n_removed > 0").count() == 0 and got.columns[-1] == "source"
    assert rows(line_dedup.dedup_lines(empty(spark))) == []


# 3 Substring dedup


@pytest.mark.parametrize("window", [50, 22])
def test_substrings(docs, window):
    data = corpus()
    out = substring_dedup.remove_spans(docs(data), substring_dedup.repeated_spans(docs(data), window=window))
    assert {r[0]: r[1:] for r in rows(out)} == brute.spans_removed(data, window)


def test_substring_edges(spark, docs):
    out = substring_dedup.remove_spans(docs(ODD), substring_dedup.repeated_spans(docs(ODD)))
    assert out.count() == len(ODD) and out.where("n_removed > 0").count() == 0
    assert rows(substring_dedup.remove_spans(empty(spark), substring_dedup.repeated_spans(empty(spark)))) == []


def test_span_sources(docs):
    passage = prose(80)
    data = [(5, f"{prose(30)} {passage} {prose(30)}"), (9, passage), (2, prose(60)), (7, f"{passage} {prose(10)}")]
    spans = rows(substring_dedup.repeated_spans(docs(data)).groupBy("doc_id").agg(F.min("start"), F.max("stop"), F.max("source_id") < F.col("doc_id")))
    assert spans == [(7, 0, 80, True), (9, 0, 80, True)]


def test_passage_repeated_inside_a_document(docs):
    draw = random.Random(11)
    passage = prose(150, draw)
    part = " ".join(passage.split()[20:105])
    data = [(1, f"{prose(30, draw)} {part} {prose(30, draw)}"), (2, " ".join(f"{passage} {prose(n, draw)}" for n in (60, 3, 0, 40))), (3, f"{part} {passage} {part}")]
    out = substring_dedup.remove_spans(docs(data), substring_dedup.repeated_spans(docs(data)))
    got = {r[0]: r[1:] for r in rows(out)}
    assert got == brute.spans_removed(data, 50) and got[2][1] == 4 * 85


def test_substrings_of_rows_that_share_an_id(docs):
    draw = random.Random(12)
    passage, other = prose(120, draw), prose(70, draw)
    tail = prose(10, draw)
    cases = [
        [(1, passage), (2, f"{tail} {passage}"), (2, "short text here")],
        [(1, passage), (1, "tiny"), (1, None), (2, f"{passage[:400]} {other}"), (3, passage)],
        [(1, passage), (1, f"{other} {passage}"), (1, f"{other} {passage}"), (2, f"{other} x"), (2, f"y {other} {passage} {passage}"), (2, f"y {passage}"), (2, f"y {passage}")],
    ]
    for data in cases:
        out = substring_dedup.remove_spans(docs(data), substring_dedup.repeated_spans(docs(data)))
        assert rows(out) == sorted(brute.spans_removed_by_row(data, 50))


def test_substrings_of_branching_documents(docs):
    draw = random.Random(14)
    parts = [prose(n, draw) for n in (60, 35, 80, 20, 120)] + ["x " * 70 + "x", "x y " * 40 + "x"]
    data = [(i // 2 if i % 7 == 0 else i, " ".join(draw.choice(parts) for _ in range(draw.randint(1, 5)))) for i in range(80)]
    out = substring_dedup.remove_spans(docs(data), substring_dedup.repeated_spans(docs(data)))
    assert rows(out) == sorted(brute.spans_removed_by_row(data, 50))


def test_spans_count_only_where_the_source_has_their_words(docs):
    passage = prose(80)
    data = docs([(1, passage), (2, passage)])
    spans = substring_dedup.repeated_spans(data)
    assert rows(substring_dedup.remove_spans(data, spans), "n_removed") == [(0,), (80,)]
    wrong = spans.withColumn("words", F.unhex(F.lit("00" * 16)))
    assert rows(substring_dedup.remove_spans(data, wrong), "n_removed") == [(0,), (0,)]


# 4 Decontamination


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks(spark, docs, limit):
    data = corpus()
    items = [(1, data[8][1][:250]), (2, edited(data[9][1], 2)), (3, prose(50)), (4, "ab cd"), (5, ""), (6, None), (None, data[0][1]), (7, data[0][1]), (8, edited(data[3][1], 30))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.leaks(docs(data), table, index_limit=limit), "doc_id", "item_id", "n_shingles", "n_shared")
    assert got == brute.leaks(data, items, 5, 80) and len(got) > 5
    left = {r[0] for r in rows(decontaminate.decontaminated(docs(data), table), "doc_id")}
    assert left == {i for i, _ in data} - {r[0] for r in got}


def test_leak_edges(spark, docs):
    items = spark.createDataFrame([(1, "é ü ß é ü ß")], "item_id long, text string")
    assert rows(decontaminate.leaks(docs(ODD), items), "doc_id", "item_id") == [(3, 1)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.leaks(docs(ODD), none)) == [] and rows(decontaminate.leaks(empty(spark), items)) == []
    assert decontaminate.decontaminated(docs(ODD), none).count() == len(ODD)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_short_items_inside_documents_and_rows_without_ids(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "INDEX_LIMIT", limit)
    items = [(1, "alpha beta gamma"), (2, "Zeta"), (3, "one two three four"), (4, " ".join(f"i{n}" for n in range(12)))]
    texts = ["x y alpha beta gamma z", "alpha beta", "ALPHA beta gamma", "so Zeta so", "zetas", "one two three", "and one two three four five", "alpha gamma beta", " ".join(f"i{n}" for n in range(12)), "", None]
    data = [(n, t) for n, t in enumerate(texts)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.leaks(docs(data), table, index_limit=limit), "doc_id", "item_id", "n_shingles", "n_shared")
    assert got == brute.leaks(data, items, 5, 80) == [(0, 1, 1, 1), (2, 1, 1, 1), (3, 2, 1, 1), (6, 3, 1, 1), (8, 4, 8, 8)]
    # One id for all, and none.
    for same in (None, 7):
        left = rows(decontaminated := decontaminate.decontaminated(docs([(same, t) for t in texts]), table), "text")
        assert left == sorted(((t,) for n, t in data if n not in {0, 2, 3, 6, 8}), key=lambda r: (r[0] is not None, r[0])) and "key" in decontaminated.columns


# 5 Language ID


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        code = language_id.codewords(n)
        apart = (code[:, None] != code[None]).sum(2)
        assert code.shape[0] == n and (apart + 100 * np.eye(n)).min() >= 1
    assert language_id.codewords(1).size == 0 and language_id.codewords(4).shape == (4, 7)


def test_held_out_accuracy(small):
    d = small["documents"]
    model = language_id.train(language_id.training_rows(d))
    out = language_id.predict(d, model).withColumn("held", language_id.held_out()).join(d.select("doc_id", "lang"), "doc_id")
    right, n = out.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right >= 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in rows(out, "doc_id", "held"))
    assert language_id.accepted(d, model).columns == d.columns


def test_language_edges(spark, docs):
    model = language_id.train(spark.createDataFrame([(i, t * 5, lang) for i, (t, lang) in enumerate([("the of and ", "en"), ("der die und ", "de"), ("le la et ", "fr")] * 4)], "doc_id long, text string, lang string"))
    got = rows(language_id.predict(docs([(1, "the and of the"), (2, "und der"), (3, None), (4, ""), (5, "12 34 !"), (None, "la et le"), (6, "x" * 200_000)]), model), "doc_id", "lang_pred")
    assert got[:6] == [(None, "fr"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert language_id.predict(docs([(1, "a")]), model).where("score between 0 and 1").count() == 1
    nothing = language_id.train(empty(spark).select("doc_id", "text", "lang"))
    assert rows(language_id.predict(docs([(1, "the")]), nothing), "lang_pred", "score") == [("und", 0.0)]
    single = language_id.train(spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string"))
    assert rows(language_id.predict(docs([(1, "the"), (2, "1")]), single), "lang_pred") == [("en",), ("und",)]
    assert rows(language_id.predict(empty(spark), model)) == []


def test_many_languages(spark, docs):
    draw = random.Random(1)
    own = {f"l{i}": [chr(97 + (i * 3 + j) % 26) * 2 + chr(97 + i % 26) for j in range(5)] for i in range(12)}
    data = [(n, " ".join(draw.choice(w) for _ in range(30)), lang) for n, (lang, w) in enumerate(list(own.items()) * 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 60"))
    wrong = language_id.predict(df, model).join(df, "doc_id").where("doc_id >= 60 and lang <> lang_pred").count()
    assert wrong <= 1


def plain_slots(text):
    """Hashed byte trigrams of a text, one for each byte."""
    low = [32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    ring = [32, *low, 32]
    return [((ring[i] << 16 | ring[i + 1] << 8 | ring[i + 2]) * 0x9E3779B1 % 2**32) >> 18 for i in range(len(low))]


def test_languages_of_few_ids_and_texts_are_learned(spark):
    data = [(1, f"{prose(5)} xx{i}", "xx") for i in range(7000)] + [(i, f"el la los de que {i}", "es") for i in range(300)] + [(2, "the same words", "en")] * 500 + [(None, "no id teaches nothing", "zz")]
    rows_ = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert language_id.train(rows_, rows_per_language=100).languages == ["en", "es", "xx"]
    sizes = dict(rows(language_id._sample(rows_.where("doc_id is not null"), 100, 5).groupBy("lang").count()))
    assert sizes["en"] == 1 and 60 <= sizes["xx"] <= 140 and 60 <= sizes["es"] <= 140


def test_training_and_decoding_by_brute_force(spark, docs):
    draw = random.Random(17)
    own = {"a": "anna otto la", "b": "bob be by", "c": "ciao c'e che", "d": "der die da"}
    data = [(n, " ".join(draw.choice(own[lang].split() + ["x1", "é"]) for _ in range(draw.randint(1, 25))), lang) for n, lang in enumerate("abcd" * 12)]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    code = language_id.codewords(4)
    counts = np.zeros((4, language_id.SLOTS))
    for _, t, lang in data:
        for slot in plain_slots(t):
            counts["abcd".index(lang)][slot] += 1
    chance = [[(c + 0.5) / (row.sum() + 0.5 * len(row)) for c in row] for row in counts]
    weights = np.array([[np.log(np.mean([chance[i][s] for i in range(4) if code[i][b] > 0])) - np.log(np.mean([chance[i][s] for i in range(4) if code[i][b] < 0])) for b in range(7)] for s in sorted({s for _, t, _ in data for s in plain_slots(t)})])
    assert np.allclose(model.weights[sorted({s for _, t, _ in data for s in plain_slots(t)})], weights, atol=1e-5)

    def plain_margins(text):
        slots = plain_slots(text)
        return [sum(float(model.weights[s][b]) for s in slots) / len(slots) * min(1, len(slots) / language_id.EVIDENCE) for b in range(7)]

    rows_of = [(plain_margins(t), "abcd".index(lang)) for _, t, lang in data]
    for b in range(7):
        assert abs(model.scale[b] - np.mean([abs(m[b]) for m, _ in rows_of])) < 1e-6
        wrong = min(max(np.mean([m[b] * code[i][b] <= 0 for m, i in rows_of]), 1e-3), 0.499)
        assert abs(model.reliability[b] - np.log((1 - wrong) / wrong)) < 1e-6
    texts = [(1, "anna be che"), (2, "bob"), (3, "der é"), (4, "x"), (5, "Otto DIE die")]
    for (_, t), (i, lang, score, unsure) in zip(texts, rows(language_id.predict(docs(texts), model)), strict=True):
        loss = [sum(np.log1p(np.exp(-3 * m * w / s)) * r for m, w, s, r in zip(plain_margins(t), code[n], model.scale, model.reliability, strict=True)) / np.mean(model.reliability) for n in range(4)]
        assert lang == "abcd"[int(np.argmin(loss))], i
        assert abs(score - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-6 and unsure == (score < language_id.SURE)


def test_a_limit_on_names_keeps_the_most_frequent_ones(spark):
    rows_of = [(n, "aa bb", "en") for n in range(40)] + [(100 + n, "cc dd", "fr") for n in range(30)] + [(1000 + n, "ee ff", f"x{n:05}") for n in range(10_000)]
    df = spark.createDataFrame(rows_of, "doc_id long, text string, lang string")
    model = language_id.train(df, max_languages=3)
    assert model.languages == ["en", "fr", "x00000"]


def test_thousands_of_names_are_learned(spark, docs):
    names = {f"x{n:04}": chr(0x4E00 + 7 * n) * 3 for n in range(2000)}
    data = [(n, f"{word} {word}", lang) for n, (lang, word) in enumerate(names.items())] + [(10_000 + n, "the same words", "en") for n in range(50)]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.languages) == 2001 and model.code.shape[1] == 110
    asked = [(n, word * 4, lang) for n, (lang, word) in enumerate(list(names.items())[::100])] + [(5000, "same words", "en")]
    told = dict(rows(language_id.predict(docs([(n, text) for n, text, _ in asked]), model), "doc_id", "lang_pred"))
    assert sum(told[n] == lang for n, _, lang in asked) >= 18


# 6 Media


def test_checksum_against_bitwise():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert media.checksum(data) == slow(data)


def test_packets_of_every_size_round_trip():
    sizes = [0, 1, 254, 255, 256, 510, 576, 70_000, 3]
    stream, end, packets = media.Stream(9), 0, []
    for n in sizes:
        end += n
        packets.append((bytes([n % 251]) * n, end))
    data = b"".join(stream.pages([(b"head", 0)]) + stream.pages(packets, last=True))
    got = media.demultiplex(data)[9]
    assert [p.data for p in got] == [b"head", *[p for p, _ in packets]]
    assert media.timed(got[1:])[-1] == (end - 3, packets[-1][0])


def test_broken_files_are_found():
    data = bytearray(media.store(media.payload_of(b"abc" * 5000)))
    assert media.read(bytes(data))[0] == media.payload_of(b"abc" * 5000)
    pages = data.split(b"OggS")
    cases = [data[:-1], data[:40], b"junk" + data, b"OggS".join(pages[:-1]), b"OggS".join([*pages[:3], *pages[4:]]), b""]
    flipped = bytearray(data)
    flipped[100] ^= 1
    for bad in (*cases, flipped):
        with pytest.raises(media.Broken):
            media.read(bytes(bad))


def test_media_columns(spark, docs):
    data = ODD + [(10, "z" * 576), (11, "z" * 577), (12, "z" * 576 * 300)]
    out = media.described(media.stored(docs(data))).toPandas()
    texts = [(t or "").encode() for _, t in data]
    assert list(out.n_bytes) == [len(t) for t in texts] and out.error.isna().all()
    for t, r in zip(texts, out.itertuples(), strict=True):
        p = t + b"\xff" * (-len(t) % 576 or (0 if t else 576))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        power, middle, crossings = [0] * (len(p) // 576), 0, 0
        for n, byte in enumerate(p):
            power[n // 576] += (byte - 128) ** 2
            middle += byte - 128
            crossings += n > 0 and (byte < 128) != (p[n - 1] < 128)
        loudest = power.index(max(power)) * 576 * 1000 // 8000
        assert r.feature == f"frames={len(power)};ms={len(p) * 1000 // 8000};mean={middle // len(p)};rms={int((sum(power) // len(p)) ** 0.5)};crossings={crossings};loudest_ms={loudest}"
    assert out.media_sha256[7] == out.media_sha256[8]
    broken = spark.createDataFrame([(1, 3, bytearray(b"OggX")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.described(broken).where("error is not null and payload_bytes is null").count() == 2
    assert rows(media.stored(empty(spark))) == []
    pages = media.page_table(media.stored(docs([(12, "z" * 576 * 100)])))
    assert rows(pages.groupBy("serial").agg(F.count(F.lit(1)), F.max("granule"))) == [(1, 3, 57_600), (2, 3, 57_600)]


# 7 URLs


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_filter.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_listed_rules(spark):
    urls = ["http://a.net/", "https://example.net/en/x?q", "http://Sub.EXAMPLE.net/en/", "http://example.com/de", "x://example.com/de/#a", "http://b.org/fr/", "http://org/fr/1", "http://xorg/fr/", "http://net", "http://net?x/y", "mailto:a", None, "", "a://b://c/d", "http://evil-example.com/de/", "http://h/\np"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for n, host, path, rule, verdict in rows(url_filter.judged_pages(pages, labels), "page_id", "host", "path", "rule", "verdict"):
        after = (urls[n] or "").partition("://")[2]
        cut = min([after.find(c) for c in "/?#" if c in after], default=len(after))
        want_host, rest = after[:cut].lower(), after[cut:]
        want_path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        want_rule, want_verdict = plain_rule(want_host, want_path)
        assert (host, path, rule, verdict) == (want_host, want_path, want_rule, want_verdict or "allow")


def test_mined_rules_against_counting(spark):
    draw = random.Random(2)
    data = []
    for i in range(400):
        kind, section, bad = draw.choice(["shop", "blog", "www"]), draw.choice(["cheap", "news", "help"]), draw.random() < 0.1
        bad = bad or (kind == "shop" and section == "cheap" and draw.random() < 0.9)
        data.append((i, f"https://{kind}.h{i % 50}.com/{section}/{i}", int(not bad), 0))
    pages = spark.createDataFrame([(i, u) for i, u, *_ in data] + [(900, None), (901, data[0][1]), (901, data[0][1])], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data] + [(None, 0, 1), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    mined = rows(url_filter.mined_rules(pages.join(bad, "page_id").select("url", "bad")))
    assert any(set(a) == {"host=shop", "path=cheap"} for a, *_ in mined)
    baskets = [(set(t), q == 0) for (t,), (_, _, q, _) in zip([r for r in [tuple(x) for x in pages.limit(400).select(url_filter.tokens(F.col("url"))).collect()]], data, strict=True)]
    for antecedent, confidence, lift, support in mined:
        has = [b for t, b in baskets if set(antecedent) <= t]
        assert abs(confidence - sum(has) / len(has)) < 1e-9 and abs(support - sum(has) / len(baskets)) < 1e-9 and confidence >= url_filter.CONFIDENCE and lift >= url_filter.LIFT
    got = {(n, v) for n, v in rows(url_filter.judged_pages(pages, labels), "page_id", "verdict")}
    rules = [set(a) for a, *_ in mined]
    for i, (t, _) in enumerate(baskets):
        assert (i, "block" if any(r <= t for r in rules) else "allow") in got
    assert rows(url_filter.judged_pages(pages.limit(0), labels)) == []
    few = url_filter.mined_verdicts(pages, url_filter.mined_rules(pages.join(bad, "page_id").select("url", "bad")), few=0)
    assert few.count() > 0


@pytest.mark.parametrize("parts", [8, 14, 30])
def test_parts_of_a_common_long_url_are_one_item(spark, parts):
    long = "https://h.com/" + "/".join(f"dir{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(parts))
    urls = [(i, long, True) for i in range(30)] + [(30 + i, f"https://h.com/x/{'ab'[i % 2]}", i < 4) for i in range(40)] + [(90, "https://h.com/diraa/other", False)]
    labelled = spark.createDataFrame([(u, b) for _, u, b in urls], "url string, bad boolean")
    mined = url_filter.mined_rules(labelled)
    got = rows(mined, "antecedent", "confidence")
    # All parts but the first one occur in the same urls; the first one is in another url too.
    together = "\n".join(sorted(f"path=dir{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(1, parts)))
    assert got == [(["path=diraa"], 30 / 31), ([together], 1.0)]
    looked_up = spark.createDataFrame([(long,), ("https://other.org/dirba",), ("https://h.com/x/a",), ("https://h.com/diraa",)], "url string")
    verdicts = dict(rows(url_filter.mined_verdicts(looked_up, mined), "url", "confidence"))
    assert verdicts == {long: 1.0, "https://other.org/dirba": 1.0, "https://h.com/diraa": 30 / 31}


def test_floor_of_mined_rules_is_a_parameter(spark):
    labelled = spark.createDataFrame([(f"https://{'bad' if i < 5 else 'good'}.com/{i}", i < 5) for i in range(10)], "url string, bad boolean")
    assert rows(url_filter.mined_rules(labelled)) == []
    assert rows(url_filter.mined_rules(labelled, least_urls=5), "antecedent") == [(["host=bad"],)]


# 8 Mixing


def mixture(spark):
    draw = random.Random(4)
    sizes = {"big": 400, "mid": 60, "tiny": 8, None: 5}
    data = [(f"{s}{i}", prose(draw.randint(1, 60), draw), s) for s, n in sizes.items() for i in range(n)]
    data = [(n, t, s) for n, (_, t, s) in enumerate(data)]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.mark.parametrize(("gain", "repeats"), [(0.5, 4.0), (1.0, 2.0), (0.0, 4.0), (1.0, 50.0)])
def test_mixture_meets_its_targets(spark, gain, repeats):
    data, df = mixture(spark)
    tokens = {}
    for _, t, s in data:
        tokens[s or ""] = tokens.get(s or "", 0) + len(t.split())
    total = sum(tokens.values())
    p = np.array([tokens[s] / total for s in sorted(tokens)])

    def entropy(q):
        return -(q * np.log(q)).sum()

    def weights(a):
        q = p**a
        return q / q.sum()

    target = entropy(p) + gain * (np.log(len(p)) - entropy(p))
    a = next(x for x in np.linspace(0, 1, 20001) if entropy(weights(x)) <= target + 1e-9 and (weights(x) / p).max() <= repeats + 1e-9)
    out = mixing.mix(df, entropy_gain=gain, max_repeats=repeats, block_tokens=300)
    drawn = dict(rows(out.groupBy("source").agg(F.sum("n_tokens").alias("t"))))
    for s, w in zip(sorted(tokens), weights(a), strict=True):
        budget = w * total
        longest = max(len(t.split()) for _, t, x in data if (x or "") == s)
        assert budget - longest - 2 <= drawn.get(s, 0) <= budget + 2, s
    whole = {s: int(w * total / tokens[s]) for s, w in zip(sorted(tokens), weights(a), strict=True)}
    for i, s, n in rows(out.groupBy("doc_id", "source").count()):
        assert n - whole[s] in (0, 1)


def brute_draws(spark, df, budget, block_tokens, keep=()):
    """(source, doc_id, epoch) drawn from df by the plan's definition; only the hashes and the exponent come from Spark."""
    counted = mixing.numbered(mixing.hashed(df, keep))
    plan = mixing.plan(counted, budget, 0.5, 4.0, block_tokens, 0)
    keyed = counted.join(plan, "source").withColumn("block", mixing.block_of(F.col("blocks"), 0))
    keyed = keyed.select("source", "doc_id", "n_tokens", "whole", "block", F.xxhash64(F.lit(0), "source", "whole", "block").alias("block_key"), F.xxhash64(F.lit(0), "whole", "row_a", "number").alias("doc_key"))
    by_source = {}
    for r in keyed.collect():
        by_source.setdefault(r["source"], []).append(r)
    tokens = {s: sum(r["n_tokens"] for r in rs) for s, rs in by_source.items()}
    total = sum(tokens.values())
    a = mixing.exponent(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), budget or total, 0.5, 4.0)
    z = sum((t / total) ** a for t in tokens.values())
    want = []
    for source, rs in by_source.items():
        share = int((tokens[source] / total) ** a / z * (budget or total))
        whole, rest = divmod(share, tokens[source])
        assert rs[0]["whole"] == whole
        blocks = {}
        for r in rs:
            blocks.setdefault((r["block_key"], r["block"]), []).append(r)
        want += [(source, r["doc_id"], e) for r in rs for e in range(whole)]
        for key in sorted(blocks):
            size = sum(r["n_tokens"] for r in blocks[key])
            if size <= rest:
                want += [(source, r["doc_id"], whole) for r in blocks[key]]
                rest -= size
                continue
            for r in sorted(blocks[key], key=lambda r: r["doc_key"]):
                if r["n_tokens"] > rest:
                    break
                rest -= r["n_tokens"]
                want.append((source, r["doc_id"], whole))
            break
    return sorted(want, key=lambda x: (x[0], x[1] is not None, x[1], x[2]))


@pytest.mark.parametrize("keep", [(), ("text", "lang")])
def test_budgets_hold_without_ids(spark, monkeypatch, keep):
    """2,000 equal rows without an id in one source, one id for all in another, ids in the third."""
    monkeypatch.setattr(mixing, "NUMBERS", 300)
    data = [(None, "w " * 10, "a", "en")] * 2000 + [(7, prose(10), "b", "en") for _ in range(100)] + [(i, prose(10), "c", None) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    for budget in (10_000, 30_000):
        out = mixing.mix(df, budget=budget, block_tokens=200, keep=keep)
        want = {}
        for source, _, _ in brute_draws(spark, df.drop("lang"), budget, 200):
            want[source] = want.get(source, 0) + 10
        total, a = 22_000, mixing.exponent(spark.createDataFrame([("a", 20_000), ("b", 1000), ("c", 1000)], "source string, tokens long"), budget, 0.5, 4.0)
        raised = {s: (t / total) ** a for s, t in (("a", 20_000), ("b", 1000), ("c", 1000))}
        drawn = dict(rows(out.groupBy("source").agg(F.sum("n_tokens").alias("t"))))
        for s, r in raised.items():
            share = r / sum(raised.values()) * budget
            assert share - 11 <= drawn[s] <= share + 1 and share - 11 <= want[s] <= share + 1
        assert rows(out) == rows(mixing.mix(df.repartition(5), budget=budget, block_tokens=200, keep=keep))
        if keep:
            assert out.where("source = 'a' and (text <> repeat('w ', 10) or lang <> 'en')").count() == 0 and out.where("source = 'c' and lang is not null").count() == 0


@pytest.mark.parametrize(("budget", "slices", "most"), [(None, 10_000, 10**7), (None, 2, 0), (9000, 3, 0), (40_000, 1, 10**7)])
def test_drawn_documents_by_brute_force(spark, budget, slices, most):
    data, df = mixture(spark)
    out = mixing.mix(df, budget=budget, block_tokens=300, slice_blocks=slices, most_bytes=most)
    assert rows(out, "source", "doc_id", "epoch") == brute_draws(spark, df, budget, 300)


def test_a_budget_beyond_the_repeats_is_an_error(spark):
    _, df = mixture(spark)
    with pytest.raises(ValueError, match="repeats"):
        mixing.mix(df, budget=10**6, max_repeats=4.0)


def test_mixing_is_a_permutation_and_repeatable(spark):
    _, df = mixture(spark)
    a = rows(mixing.mix(df, block_tokens=300))
    assert a == rows(mixing.mix(df.repartition(7), block_tokens=300))
    assert len({x[5:] for x in a if x[3] == 0}) == len([x for x in a if x[3] == 0])


def test_mixing_edges(spark, docs):
    out = mixing.mix(docs(ODD), keep=("lang",))
    assert out.count() > 0 and out.where("n_tokens is null").count() == 0
    assert rows(mixing.mix(empty(spark))) == []
    assert rows(mixing.mix(docs([(1, ""), (2, None)]))) == []
    same = mixing.mix(docs([(1, "a b"), (1, "a b"), (2, "c")]))
    assert rows(same, "doc_id") == [(1,), (1,), (2,)]


# 9 Near dedup


@pytest.mark.parametrize(("k", "percent", "block", "many"), [(3, 85, 10**6, 10**6), (5, 80, 10**6, 7), (3, 85, 700, 10**6), (2, 60, 1500, 20)])
def test_near_duplicates(docs, k, percent, block, many):
    data = corpus()
    got = {i: (n, c, keep) for i, n, c, keep in rows(near_dedup.near_duplicates(docs(data), k=k, percent=percent, block_shingles=block, block_documents=many))}
    want = brute.near(data, k, percent)
    assert got == {i: (len(brute.shingles(t, k)), want[i], want[i] == i) for i, t in data}


def test_small_sets_at_the_threshold(docs):
    data = [(n, " ".join(f"w{j}" for j in range(n + 2))) for n in range(1, 12)] + [(20 + n, " ".join(f"w{j}" for j in range(n + 3))) for n in range(1, 12)]
    got = dict(rows(near_dedup.near_duplicates(docs(data), k=3, percent=85), "doc_id", "component_id"))
    assert got == brute.near(data, 3, 85)


def test_near_edges(spark, docs):
    got = rows(near_dedup.near_duplicates(docs(ODD + [(7, "same words here again"), (7, "é ü ß " * 5)]), k=3, percent=85), "doc_id", "component_id", "kept")
    # Document 7 has a text of document 3 and one of document 6, which links all three.
    assert got == [(None, None, True), (None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 3, False), (6, 3, False), (7, 3, False), (7, 3, False)]
    assert rows(near_dedup.near_duplicates(empty(spark))) == []


def test_registers_estimate_similarity():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (500, 1500, 2500):
        a, b = values[: shared + (3000 - shared) // 2], np.r_[values[:shared], values[shared + (3000 - shared) // 2 :]]
        table = near_dedup.sketch(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        assert abs(near_dedup.estimate(table[0], table[1], len(a), len(b)) - shared / 3000) < 0.1
    one, two = near_dedup.sketch(values[:100], np.zeros(100, int), 1), near_dedup.sketch(values[50:200], np.zeros(150, int), 1)
    union = near_dedup.sketch(values[:200], np.zeros(200, int), 1)
    assert (np.maximum(one, two) == union).all()


# 10 Personal data


def test_base_spans(docs):
    texts = [None, "", "a@b.c_é@f.org x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111-1111 1111 é 4111111111111111 12", "+1 (017) 555-7713, +12 +123456789012345678 ++49 30 1234567", "é" * 50 + "z@q.de", "9" * 5000, "a" * 100_000, "a@b" * 3000, "1.1." * 2000]
    data = list(enumerate(texts)) + [(3, texts[3]), (None, texts[2])]
    got = rows(pii.personal_data(docs(data)), "doc_id", "base_sha256")
    want = [(i, hashlib.sha256(brute.personal(t).encode()).hexdigest()) for i, t in data]
    assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_base_spans_of_long_runs(docs):
    n, many = 20_000, 1_000
    texts = ["a@b" + ".c" * 100_000, "a@b.c" + "@d.e" * 300, "+1" + " 2" * many, "1-" * n + "1", "1." * many, "+" * n + "1", "x" * n + "1" + "-" * n, "a." * n + "@b.c", "a@" * n, "1 " * many, "+1" + "-2" * n]
    data = list(enumerate(texts))
    got = rows(pii.personal_data(docs(data)), "doc_id", "base_sha256")
    assert got == [(i, hashlib.sha256(brute.personal(t).encode()).hexdigest()) for i, t in data]


def test_base_spans_of_random_texts(docs):
    draw = random.Random(13)
    parts = ["a", "Z9", "@", ".", "-", "+", "1", "25", "256", " ", "é", "(", ")", "%", "_", "\u00a0", "4111 1111 1111 1111", "+1 017 5557713", "x@y.z", "1.2.3.4", "\t"]
    data = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(1, 40)))) for i in range(600)]
    got = rows(pii.personal_data(docs(data)), "doc_id", "base_sha256")
    assert got == [(i, hashlib.sha256(brute.personal(t).encode()).hexdigest()) for i, t in data]


@pytest.mark.parametrize(("trust", "support"), [(0.8, 3), (0.25, 1)])
def test_extraction_by_brute_force(docs, trust, support):
    draw = random.Random(21)
    labels = ["tel:", "Tel:", "mail", "(host", "id7:", "card no", "room", "the"]
    real = {"tel:": "+1 (017) 555-77{}", "Tel:": "+1 (017) 555-77{}", "mail": "a{}@b.org", "(host": "10.0.0.{}", "card no": "4111 1111 1111 1111", "id7:": "+49 30 123456{}", "room": "12{}", "the": "a{}b"}
    texts = [None, "", " 5", "x"]
    for _ in range(150):
        part = []
        for _ in range(draw.randint(1, 3)):
            label = draw.choice(labels)
            value = real[label].format(draw.randint(10, 24)) if draw.random() < 0.8 else f"{draw.randint(100, 102)}"
            part += [draw.choice(VOCABULARY[:5]), label, value + draw.choice(["", ",", ".", ")"]), draw.choice(["end", "ok;", ""])]
        texts.append(" ".join(part))
    got = rows(pii.personal_data(docs(list(enumerate(texts))), trust, support), "doc_id", "spans", "n_found")
    assert [s for _, s, _ in got] == brute.extracted([t or "" for t in texts], trust, support)
    assert sum(n for *_, n in got) > 10


def test_patterns_find_unseen_identifiers(spark, docs):
    seeds = [(i, f"{prose(5)} hotline: +1 (017) 555-77{10 + i} open") for i in range(20)]
    hidden = [(100 + i, f"{prose(5)} hotline: 555 {i} open and badge 00{i}") for i in range(2)]
    clean = [(200 + i, f"the year {1900 + i} and room {i}a") for i in range(30)] + [(300, "the 4111111111111111"), (301, "the 12")]
    out = {i: (s, n) for i, s, n in rows(pii.personal_data(docs(seeds + hidden + clean)), "doc_id", "spans", "n_found")}
    for i, text in hidden:
        at = text.index("hotline:") + 9
        assert out[i] == (f"phone:{at}:{at + 3}", 1)
    assert all(out[i][1] == 0 for i, _ in seeds + clean)
    assert rows(pii.personal_data(empty(spark))) == []


def test_contexts_are_words_of_the_text(docs):
    texts = ["  call tel2: 0171 1.2.3.4 5.6.7.8,9.9.9.9\tx@y.zq end", "4111 1111 1111 1111 +1 (017) 555-7713) b2 \n", "id7:77", "é" * 90 + " 12 " + "é" * 91]
    got = rows(pii.matches(docs(list(enumerate(texts)))), "kind", "value", "left", "right")
    long = [hashlib.sha256(("é" * n).encode()).hexdigest() for n in (90, 91)]
    want = [("word", "0171", "tel2:", "1.2.3.4"), ("ip", "1.2.3.4", "0171", "5.6.7.8,9.9.9.9"), ("ip", "9.9.9.9", "5.6.7.8,", "x@y.zq"), ("email", "x@y.zq", "5.6.7.8,9.9.9.9", "end"), ("word", "tel2:", "call", "0171"), ("phone", "+1 (017) 555-7713", "1111", ")"), ("word", "b2", "555-7713)", ""), ("word", "id7:77", "", ""), ("word", "12", *long), ("card", "4111 1111 1111 1111", "", "+1")]
    assert set(want) <= set(got)


def test_candidates_after_words_with_digits(docs):
    seeds = [(i, f"call tel2: +1 (017) 555-77{10 + i} open") for i in range(20)]
    hidden = [(100, "call tel2: 5557719 open"), (101, "call tel3: 5557719 open")]
    out = {i: (s, n) for i, s, n in rows(pii.personal_data(docs(seeds + hidden)), "doc_id", "spans", "n_found")}
    assert out[100] == ("phone:11:18", 1) and all(out[i][1] == 0 for i, _ in seeds)


def test_long_chains_of_patterns_are_followed(docs):
    steps = 7
    data = [f"label0: +1 (017) 555-77{10 + i} end" for i in range(20)]
    # The values of label n occur with label n + 1 too, the last label's own only there.
    data += [f"label{n}: {n}00{i} end" for n in range(steps) for i in range(3)]
    data += [f"label{n + 1}: {n}00{i} end" for n in range(steps) for i in range(3)]
    found = rows(pii.personal_data(docs(list(enumerate(data))), trust=0.1), "n_found")
    assert found == [(0,)] * 20 + [(1,)] * (6 * steps)


# All with SQL


@pytest.fixture(scope="module")
def db():
    return connect("/root/testdata/sf0.001")


def test_queries_equal_sql(spark, db):
    from sparkreel.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))
    for name, sql in ORACLE_SQL.items():
        assert differences(QUERIES[name](spark, "/root/testdata/sf0.001"), db, sql) is None, name
