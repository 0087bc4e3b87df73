"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    collocations,
    decontaminate,
    language_id,
    line_dedup,
    lm_score,
    media,
    mixing,
    near_dedup,
    ngram_join,
    oracles,
    pii,
    substring_dedup,
    url_filter,
)

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.backoff_scores(_table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents"))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    kept = substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs, window=50))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=5, percent=80)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language_id.train(language_id.training_rows(docs))
    return language_id.predict(docs, model).withColumn("held_out", language_id.held_out())


def op6_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.described(media.stored(_table(spark, folder, "documents"))).drop("error")


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged_pages(_table(spark, folder, "pages"), _table(spark, folder, "labels"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), k=3, percent=85)


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_table(spark, folder, "documents"))


def op11_alignment(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return alignment.aligned(_table(spark, folder, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_documents(_table(spark, folder, "documents"), k=4, percent=85)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.phrases(_table(spark, folder, "documents"))


def media_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can say of op6_media."""
    return op6_media(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can say of op7_url_filter."""
    return op7_url_filter(spark, folder).select("page_id", "host", "path", "rule")


def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The source totals that op8_mixing begins with."""
    docs = _table(spark, folder, "documents")
    return mixing.source_tokens(docs.select("source", mixing.token_count(F.col("text")).alias("n_tokens")))


def pii_base(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can say of op10_pii."""
    return op10_pii(spark, folder).drop("spans", "n_found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_media": op6_media,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_ngram_join": op12_ngram_join,
    "op13_collocations": op13_collocations,
    # Columns of an operator that SQL can express, where it cannot express all.
    "media_payloads": media_payloads,
    "url_rules": url_rules,
    "mixing_sources": mixing_sources,
    "pii_base": pii_base,
}
ORACLE_SQL: dict[str, str] = {
    "op1_lm_score": oracles.backoff_scores(lm_score.ALPHA, lm_score.MIN_COUNT),
    "op2_line_dedup": oracles.line_dedup(3),
    "op3_substring_dedup": oracles.substring_dedup(50),
    "op4_decontaminate": oracles.leaks(5, 80),
    "op9_near_dedup": oracles.near_duplicates(3, 85),
    "op12_ngram_join": oracles.linked_documents(4, 85),
    "op13_collocations": oracles.phrases(collocations.LEAST, collocations.TOP, collocations.INSIDE),
    "media_payloads": oracles.media_payloads(media.FRAME),
    "url_rules": oracles.listed_urls(url_filter.LISTED),
    "mixing_sources": oracles.source_tokens(),
    "pii_base": oracles.personal_data(),
}
