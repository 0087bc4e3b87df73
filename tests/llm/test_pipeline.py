import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from sparkreel.llm import language_id, mixing
from sparkreel.llm.common import cut
from tests.conftest import rows

from . import brute
from .test_operators import brute_draws

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    seen = []
    for name, stage in pipeline.STAGES:
        old, before = docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = cut(stage(spark, docs, FOLDER), name)
        after = dict(rows(docs, "doc_id", "text"))
        if name == "language":
            # Training and decoding have a test of their own.
            told = language_id.predict(old, language_id.train(language_id.training_rows(old)))
            assert set(after) == {i for i, lang, score in rows(told, "doc_id", "lang_pred", "score") if lang != "und" and score >= 0.5}
            assert len(after) >= 0.95 * len(before)
        elif name == "lines":
            want = brute.lines_removed(before, 3)
            texts = dict(before)
            assert after == {i: t for i, t in want if t == texts[i] or t.strip(" ")}
        elif name == "near_duplicates":
            want = brute.near(before, 5, 80)
            assert set(after) == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            assert set(after) == {i for i, _ in before} - {x[0] for x in brute.leaks(before, items, 5, 80)}
        else:
            assert rows(docs, "source", "doc_id", "epoch") == brute_draws(spark, old, None, mixing.BLOCK_TOKENS, keep=("text", "lang", "n_chars"))
            tokens = docs.agg(F.sum("n_tokens")).first()[0]
            assert 0.8 * sum(len(brute.words(t)) for _, t in before) <= tokens <= sum(len(brute.words(t)) for _, t in before)
        if name != "mixing":
            assert docs.columns == list(pipeline.COLUMNS)
        seen.append(len(after))
    assert seen == sorted(seen, reverse=True)


def test_run_and_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, None, "en", "a", 3), (2, "", None, None, None), (3, "12 34", "en", "b", -1), (4, "the same words", None, "", None), (4, "the same words", None, "", None), (None, "words without an id", "de", None, 0), (5, "x" * 100_000, "fr", "a", None)]
    full = [(100 + i, "the and of that with words " * (3 + i), "en", "a", None) for i in range(8)] + [(200 + i, "der die und nicht auf worte " * (3 + i), "de", "b", None) for i in range(8)]
    docs = spark.createDataFrame(odd + full, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "score", "block", "print", "lines", "n_tokens", "component"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in pipeline.STAGES:
        out = cut(stage(spark, docs, FOLDER), name)
        ids = {r[0] for r in out.select("doc_id").collect()}
        if name == "language":
            assert ids >= {100, 200} and not ids & {1, 2, 3}
        elif name == "lines":
            assert {1, 2, 3, 4, 5, None} <= ids and out.count() == docs.count()
        elif name == "near_duplicates":
            assert {1, 2, 3, 4, 5, None} <= ids and out.where("doc_id = 4").count() == 2
        elif name == "decontamination":
            assert out.count() == docs.count()
        else:
            assert out.count() > 0
        if name != "mixing":
            assert out.columns == list(pipeline.COLUMNS)
