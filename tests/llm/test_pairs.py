import random

import pytest
from pyspark.sql import functions as F

from sparkreel.llm import alignment, collocations, oracles, queries, shards
from tests.compare import connect, differences
from tests.conftest import rows

from . import brute
from .test_operators import ODD, corpus, edited, empty

FIRST, SECOND = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
STRANGE = ["abc ", " abc", "  a  b", "a\n b", "a \n  b\t c", "<s> x </s> <unk>", "<|endoftext|> q", "\u2581a", "a\u2581b", "\u00a0a", "\x00 a\x01", "  ", " ", "\n", "a\u3000b",
           "\u65e5\u672c \u8a9e x", "don't 's 're", "a\x1c b", "\u2028 a\u2029b c", "<0x41> b", "a\x85 b", "e\u0301 \ufb01", "\U0001f600 \U0001f468\u200d\U0001f469", "a\r\n b", "'s 's", "1 234  5"]


def letters(draw, n):
    return "".join(draw.choice(" \t\n ab'sé\u2581\u00a0\u3000.,12\x1c\u65e5") for _ in range(n))


def test_alignment_equals_whole_texts_byte_by_byte(docs):
    draw = random.Random(5)
    found = [*corpus(), *ODD, *enumerate(STRANGE), *((i, letters(draw, draw.randint(1, 30))) for i in range(300))]
    for remembered in (alignment.REMEMBERED, 500):
        ours = alignment.aligned(docs(found), FIRST, SECOND, shard_rows=200, remembered=remembered)
        assert rows(ours) == rows(ours.sparkSession.createDataFrame(brute.alignment(found, FIRST, SECOND), alignment._DIGESTS))


def test_alignment_of_documents_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ours = queries.op11_alignment(spark, "/root/testdata/sf0.001")
    assert rows(ours) == rows(spark.createDataFrame(brute.alignment(docs, FIRST, SECOND), alignment._DIGESTS))


def test_alignment_of_nothing(spark):
    assert alignment.aligned(empty(spark), FIRST, SECOND).count() == 0


def test_units_join_to_the_text():
    for text in STRANGE:
        assert "".join(" " + u for u in alignment.units(text)) == " " + text


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_shards_find_what_is_there(spark, n):
    draw = random.Random(n)
    keys = sorted({draw.randrange(-(2**62), 2**62) for _ in range(n)})
    df = spark.createDataFrame([(k, i, f"v{i}") for i, k in enumerate(keys)], "key long, n long, word string")
    found = shards.written(df.repartitionByRange(3, "key").sortWithinPartitions("key"), "test")
    import numpy as np

    asked = np.array([*keys, -5, 7, 2**63 - 1, -(2**63)], np.int64)
    draw.shuffle(asked)
    places = {k: i for i, k in enumerate(keys)}
    assert found.rank(asked).tolist() == [places.get(int(k), -1) for k in asked]
    assert found.values(asked, "n", missing=-7).tolist() == [places.get(int(k), -7) for k in asked]
    assert found.strings(np.arange(len(keys)), "word") == [f"v{i}" for i in range(len(keys))]


def test_run_lengths_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        draw = random.Random(1)
        some = [(draw.randrange(9), 1) for _ in range(200)]
        df = spark.createDataFrame(some, "key long, n long").repartition(1).sortWithinPartitions("key")
        sums = {k: sum(1 for x, _ in some if x == k) for k in range(9)}
        assert rows(df.mapInArrow(shards.run_lengths(), "key long, n long")) == sorted(sums.items())
        wide = df.select(F.encode(F.concat(F.lit("abcd"), F.col("key").cast("string")), "utf-8").alias("key"), "n").sortWithinPartitions("key")
        assert rows(wide.mapInArrow(shards.run_lengths(5, 20), "key binary, n long")) == [(f"abcd{k}".encode(), n) for k, n in sorted(sums.items()) if n >= 20]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Phrases


def sql_phrases(spark, rows_, tmp_path, least, top):
    spark.createDataFrame(rows_, "doc_id long, text string, lang string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return db, oracles.phrases(least, top, 50)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_sql_on_odd_rows(spark, tmp_path, seed):
    draw = random.Random(seed)
    said = lambda: "".join(draw.choice(["a", "b", "c", "B", "é", " ", " ", "  ", "\t", ".", ",", "\n", "\r", "\x0b", "d e", "\u00a0"]) for _ in range(draw.randint(0, 80)))
    found = [(draw.choice([None, 1, i]), draw.choice([None, "", said(), said(), said()]), draw.choice([None, "en", "de", "und"])) for i in range(200)]
    found += [(7, "x " * 30_000, "en"), (7, "x y " * 300, "en"), (8, "x" * 100_000, "en")] + [(9, "same words here again", "fr")] * 12
    for least, top in ((2, 50), (10, 5)):
        db, sql = sql_phrases(spark, found, tmp_path, least, top)
        df = spark.createDataFrame(found, "doc_id long, text string, lang string").withColumns({n: F.lit(-1) for n in ("key", "word", "part", "n", "rank")})
        assert differences(collocations.phrases(df, least=least, top=top, range_words=500, shard_rows=7), db, sql) is None


def test_phrases_score_beyond_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**9, 5 * 10**9, 6 * 10**9, 10**14, 10**14)], "a long, l1 long, r1 long, l2 long, r2 long")
    got = df.select(collocations._score("l1", "r1"), collocations._score("l2", "r2")).first()
    assert tuple(got) == (10**6 * 16 * 10**18 // (30 * 10**18), 10**6 * 16 * 10**18 // 10**28)


def test_phrases_of_nothing(spark):
    assert collocations.phrases(empty(spark)).count() == 0
    assert collocations.phrases(spark.createDataFrame([(None, None), ("", "en"), (" . ", "en")], "text string, lang string")).count() == 0


def test_phrases_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert differences(queries.op13_collocations(spark, folder), connect(folder), queries.ORACLE_SQL["op13_collocations"]) is None


# N-gram join


def components_of(found, k, percent):
    """{row: (set size, smallest id reachable)} by comparing all pairs of rows."""
    sets = [brute.shingles(t, k) for _, t in found]
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc_id, _) in enumerate(found):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), low.get(top(i))) for i, (doc_id, _) in enumerate(found)]


@pytest.mark.parametrize(("k", "percent", "rounds", "nodes", "shingles"), [(4, 85, 2, 1000, 2_000_000), (4, 85, 0, 5, 2_000_000), (5, 80, 1, 1000, 500), (2, 60, 0, 7, 900)])
def test_ngram_join_equals_all_pairs(docs, k, percent, rounds, nodes, shingles):
    from sparkreel.llm import ngram_join

    draw = random.Random(k)
    base = " ".join(draw.choice("abcdefghijklmnop") + str(draw.randrange(9)) for _ in range(60))
    near = [edited(base, draw.randint(0, 4), draw) for _ in range(80)]
    small = [" ".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    found = [*corpus(), *((1000 + i, t) for i, t in enumerate(near + small)), (None, near[0]), (None, near[1] + " x"), (None, "alone here today you"), (2000, near[2]), (2000, "other text with this id"), *ODD]
    got = ngram_join.linked_documents(docs(found), k=k, percent=percent, rounds=rounds, block_nodes=nodes, block_shingles=shingles)
    assert rows(got) == rows(got.sparkSession.createDataFrame(components_of(found, k, percent), "doc_id long, n_shingles long, component_id long"))


def test_fragments_of_linked_sets_meet():
    import numpy as np

    from sparkreel.llm import kernels, ngram_join

    draw = random.Random(9)
    counts = np.array([draw.randrange(50) for _ in range(1 << ngram_join.COUNTER_BITS)], np.int64)
    for percent in (60, 80, 85):
        for _ in range(300):
            n = draw.choice([3, 6, 7, 8, 12, 20, 45, 150, 900])
            m = draw.randint(n, 100 * n // percent)
            least = -(-percent * (n + m) // (100 + percent))
            if least > n:
                continue
            every = np.unique(kernels.mix(np.array([draw.randrange(2**64) for _ in range(n + m - least)], np.uint64)))
            draw_order = list(range(len(every)))
            draw.shuffle(draw_order)
            one, two = np.sort(every[draw_order[:n]]), np.sort(every[draw_order[n - least :]])
            if 100 * least < percent * (n + m - least) or n == m == least:
                continue
            keys, owner = ngram_join.kept_fragments(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), percent, counts)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_long_sets_meet_in_fragments(docs, monkeypatch):
    from sparkreel.llm import ngram_join

    draw = random.Random(2)
    base = [f"w{draw.randrange(10**6)}" for _ in range(9000)]
    cut = base[: int(len(base) * 0.87)]
    far = base[:4000] + [f"v{i}" for i in range(5000)]
    found = [(1, " ".join(base)), (2, " ".join(cut)), (3, " ".join(far)), (4, " ".join(base[:-1] + ["end"])), (5, " ".join(cut[:200]))]
    got = ngram_join.linked_documents(docs(found), k=4, percent=85)
    assert [r[2] for r in rows(got)] == [1, 1, 3, 1, 5]


def test_ngram_join_of_nothing(spark):
    from sparkreel.llm import ngram_join

    assert ngram_join.linked_documents(empty(spark)).count() == 0
    assert rows(ngram_join.linked_documents(spark.createDataFrame([(1, ""), (2, None), (None, None)], "doc_id long, text string"))) == [(None, 0, None), (1, 0, 1), (2, 0, 2)]
