"""A corpus pipeline over `documents`: five stages, each on all that the one before kept.

Rows without an id, with null columns, with ids or whole rows that repeat are
documents like others; each stage's function says what becomes of them. Columns
beyond those of documents are left out. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from sparkreel.llm.common import discard, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no language with a score of at least one half.

    Null and empty texts have no letter and go. Null languages teach nothing; if no
    row teaches, a letter is enough. A row's fate depends on its text alone, so
    repeated rows stay or go together.
    """
    model = language_id.train(language_id.training_rows(docs))
    return language_id.accepted(docs.select(*COLUMNS), model, least=0.5)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows; a document of which nothing is left goes.

    Null texts and rows without an id have no windows and stay as they are. Of equal
    windows the one with the smallest (id, hash of the text, place) stays. Repeated
    rows are one document, cut alike.
    """
    out = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    return out.where(left).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked at 0.8 or more.

    That with the smallest id stays, with all its rows. Null and empty texts and rows
    without an id are linked with nothing and stay.
    """
    gone = near_dedup.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item's five-word shingles to 0.8 or more.

    A row goes if its own text holds an item, whatever its id. Null and empty texts
    hold none and stay; items without an id or words are none.
    """
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of documents by temperature-mixed source weights, with their place in the permutations.

    A null source is the source ''. Null and empty texts have no tokens: a source of
    such documents only is not drawn. Repeated rows are drawn together or not at all.
    """
    return mixing.mix(docs, keep=("text", "lang", "n_chars"))


STAGES = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", not_leaked),
    ("mixing", mixed),
]

#: The classifier of the first stage is trained, which SQL cannot express; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each read from a table that the one before left."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
