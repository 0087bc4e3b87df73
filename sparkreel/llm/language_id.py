"""Language ID with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed byte trigrams (naive Bayes between the languages that have the bit and
those that have not) gives a margin. Decoding picks the codeword with the
smallest loss, where a bit's loss is weighted by how reliable the bit was on the
training rows. A small distance to the runner-up flags the text as ambiguous.

Training uses at most about `rows_per_language` rows of each language, chosen by a
hash of id and text, one at least. However many names there are, all are learned:
Spark sums their counts into two tables a bit, and bits grow with the logarithm of
the number of names. Prediction reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, discard, stored, text_column

ROWS_PER_LANGUAGE = 5_000
SLOTS = 1 << 14
#: Codes of random bits beyond this many languages; all distinct splits up to it.
EXHAUSTIVE = 5
#: Codes of random bits that are drawn, the best of which stays, and the number of pairs of languages that they may cost; one at least.
DRAWS, PAIRS = 200, 200 * 256**2
#: Tasks that sum what languages add to bits.
SUM_TASKS = 16
#: Losses, of texts times languages, that decoding holds at a time.
LOSSES = 1 << 22
#: A text is ambiguous if its score stays below this.
SURE = 0.75
#: Trigrams after which more text no longer raises confidence in a bit.
EVIDENCE = 40.0
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # [languages, bits] of -1 and 1
    weights: np.ndarray  # [SLOTS, bits]
    scale: np.ndarray  # typical margin of each bit
    reliability: np.ndarray


def codewords(n: int) -> np.ndarray:
    """[n, bits] of -1 and 1: every split of up to EXHAUSTIVE languages, else seeded random bits far apart."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = [[1, *(1 if s >> i & 1 else -1 for i in range(n - 1))] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).reshape(-1, n).T
    bits, draw = max(15, math.ceil(10 * math.log2(n))), np.random.default_rng(0)
    best, most, draws = None, -1, min(DRAWS, PAIRS // n**2)
    if draws < 2:
        return draw.choice(np.array([-1, 1], np.int8), (n, bits))
    for _ in range(draws):
        tried = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        agree = tried.astype(np.float32) @ tried.T
        np.fill_diagonal(agree, -bits)
        apart = (bits - agree.max()) / 2
        if apart > most:
            best, most = tried, apart
    return best


def _slots(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hashed trigram for every byte: it and its neighbours, blanks outside the text; A-Z lower-cased."""
    low = buf.astype(np.uint32)
    low[(buf >= 65) & (buf <= 90)] += 32
    low[(buf >= 9) & (buf <= 13)] = 32
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[:-1][filled]] = 32
    after[offsets[1:][filled] - 1] = 32
    gram = before << np.uint32(16) | low << np.uint32(8) | after
    return (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - 14)).astype(np.int64)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """[rows, bits]: mean weight of each text's trigrams, shrunk towards 0 for short texts."""
    out = np.zeros((len(texts), weights.shape[1]), np.float64)
    for rows, buf, offsets in K.sliced(texts, 1 << 18):
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            sums = np.add.reduceat(weights[_slots(buf, offsets)], offsets[:-1][filled], axis=0, dtype=np.float64)
            n = np.diff(offsets)[filled, None]
            out[rows.start + filled] = sums / n * np.minimum(1, n / EVIDENCE)
    return out


_COUNTS = "lang string, slots binary, counts binary"
_SUMS = "bit int, plus binary, minus binary"


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often which slots occur in a language's rows; rows come sorted by language, so one language is held at a time."""
    lang, counts = None, np.zeros(SLOTS, np.int64)

    def said() -> pa.RecordBatch:
        some = np.flatnonzero(counts)
        return pa.record_batch([pa.array([lang]), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([counts[some].tobytes()], pa.binary())], names=["lang", "slots", "counts"])

    for batch in batches:
        names = batch.column("lang").to_pylist()
        for rows, buf, offsets in K.sliced(batch.column("text"), 1 << 18):
            slots = _slots(buf, offsets)
            for row, a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if names[row] != lang:
                    if lang is not None:
                        yield said()
                    lang = names[row]
                    counts[:] = 0
                np.add.at(counts, slots[a:b], 1)
    if lang is not None:
        yield said()


def _sum_task(group: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS, np.int64)
    for slots, counts in zip(group["slots"], group["counts"], strict=True):
        total[np.frombuffer(slots.as_py(), np.int32)] += np.frombuffer(counts.as_py(), np.int64)
    some = np.flatnonzero(total)
    return pa.table({"lang": group["lang"].slice(0, 1), "slots": pa.array([some.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([total[some].tobytes()], pa.binary())})


def _bit_task(languages: list[str], code: np.ndarray):
    """For each bit the summed chances of slots in the task's languages that have the bit, and in those that have not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((2, code.shape[1], SLOTS)), False
        for batch in batches:
            which = pc.index_in(batch.column("lang"), pa.array(languages)).to_numpy(zero_copy_only=False)
            for row, slots, counts in zip(which, batch.column("slots"), batch.column("counts"), strict=True):
                chance = np.full(SLOTS, 0.5)
                chance[np.frombuffer(slots.as_py(), np.int32)] += np.frombuffer(counts.as_py(), np.int64)
                chance /= chance.sum()
                for side, sign in enumerate((1, -1)):
                    sums[side, code[row] == sign] += chance
                seen = True
        for bit in range(code.shape[1] if seen else 0):
            yield pa.record_batch([pa.array([bit], pa.int32()), *[pa.array([sums[side, bit].tobytes()], pa.binary()) for side in (0, 1)]], names=["bit", "plus", "minus"])

    return run


def _bit_sum_task(group: pa.Table) -> pa.Table:
    sums = {side: sum(np.frombuffer(part.as_py()) for part in group[side]) for side in ("plus", "minus")}
    return pa.table({"bit": group["bit"].slice(0, 1)} | {side: pa.array([total.tobytes()], pa.binary()) for side, total in sums.items()})


def _margin_task(languages: list[str], code: np.ndarray, weights: np.ndarray):
    """For each bit the number of a batch's rows, the summed size of their margins and how many have the wrong sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = pa.array(np.arange(code.shape[1], dtype=np.int32))
        for batch in batches:
            which = pc.index_in(batch.column("lang"), pa.array(languages)).to_numpy(zero_copy_only=False)
            values = margins(batch.column("text"), weights)
            yield pa.record_batch([bits, pa.array(np.full(len(bits), len(values))), pa.array(np.abs(values).sum(0)), pa.array((values * code[which] <= 0).sum(0))], names=["bit", "n", "size", "wrong"])

    return run


def _sample(rows: DataFrame, rows_per_language: int, max_languages: int | None = None) -> DataFrame:
    """lang, text of about rows_per_language different rows of each language, or of the max_languages most frequent ones, by a hash of id and text; one of each at least.

    Equal rows are one, so a text that is there very often neither fills the sample
    nor stands for a language alone. Ties of frequency go to the first name. The table
    of languages is stored, so that Spark broadcasts it if its size allows.
    """
    rows = rows.withColumn("hash", F.xxhash64(F.lit(5), "doc_id", "text"))
    different = rows.select("lang", "hash").distinct()
    sizes = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first"))
    if max_languages is not None:
        sizes = sizes.orderBy(F.col("n").desc(), "lang").limit(max_languages)
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("n"))
    drawn = F.pmod("hash", F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = rows.join(cut(sizes.select("lang", share.alias("share"), "first"), "languages"), "lang").where((drawn < F.col("share")) | (F.col("hash") == F.col("first")))
    return some.select("lang", "hash", "text").dropDuplicates(["lang", "hash"]).select("lang", "text")


def train(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int | None = None) -> Model:
    """A model from rows(doc_id, text, lang); rows without one of them teach nothing.

    The sample is stored once. To the driver come the names of the languages that
    are learned (all, unless max_languages is given), and for each bit two tables of
    SLOTS numbers and two figures.
    """
    rows = rows.where("lang is not null and text is not null and doc_id is not null")
    sample, sample_at = stored(_sample(rows, rows_per_language, max_languages), "sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # names alone
    code = codewords(len(languages))
    if code.size == 0:
        discard(rows.sparkSession, sample_at)
        return Model(languages, code, np.zeros((SLOTS, 0), np.float32), np.ones(0), np.ones(0))
    counts = sample.sortWithinPartitions("lang").mapInArrow(_count_task, _COUNTS).groupBy("lang").applyInArrow(_sum_task, _COUNTS)
    sums = counts.coalesce(SUM_TASKS).mapInArrow(_bit_task(languages, code), _SUMS).groupBy("bit").applyInArrow(_bit_sum_task, _SUMS)
    weights = np.zeros((SLOTS, code.shape[1]), np.float32)
    for r in sums.collect():  # one for each bit
        own = code[:, r["bit"]]
        weights[:, r["bit"]] = np.log(np.frombuffer(r["plus"]) / (own > 0).sum()) - np.log(np.frombuffer(r["minus"]) / (own < 0).sum())
    judged = sample.mapInArrow(_margin_task(languages, code, weights), "bit int, n long, size double, wrong long")
    judged = judged.groupBy("bit").agg((F.sum("size") / F.sum("n")).alias("scale"), (F.sum("wrong") / F.sum("n")).alias("wrong"))
    stats = {r["bit"]: r for r in judged.collect()}  # one for each bit
    discard(rows.sparkSession, sample_at)
    wrong = np.clip([stats[b]["wrong"] for b in range(code.shape[1])], 1e-3, 0.499)
    return Model(languages, code, weights, np.maximum([stats[b]["scale"] for b in range(code.shape[1])], 1e-9), np.log((1 - wrong) / wrong))


def decode(model: Model, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score) by the least reliability-weighted logistic loss to a codeword."""
    if len(model.languages) == 1:
        return np.zeros(len(values), int), np.ones(len(values))
    # A bit that a codeword has costs log(1 + exp(-x)), one that it has not costs x more.
    x = 3 * values / model.scale
    without = (np.logaddexp(0, -x) * model.reliability).sum(1)
    lacks = (model.code < 0).T.astype(np.float64)
    best, score = np.zeros(len(values), int), np.zeros(len(values))
    step = max(1, LOSSES // len(model.languages))
    for at in range(0, len(values), step):
        part = slice(at, at + step)
        loss = (without[part, None] + (x[part] * model.reliability) @ lacks) / model.reliability.mean()
        best[part] = loss.argmin(1)
        score[part] = 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)
    return best, score


def _predict_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            if model.languages:
                best, score = decode(model, margins(texts, model.weights))
                best, score = np.where(letters, best, len(model.languages)), np.where(letters, score, 0.0)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs(doc_id, text).

    Text that is null or has no letter is `und` with score 0; so is everything if
    nothing was learned. Ids are passed on, null or repeated. Ties go to the first
    language by name. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict_task(model), "doc_id long, lang_pred string, score double").withColumn("ambiguous", F.col("score") < SURE)


def _accept_task(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            score = decode(model, margins(texts, model.weights))[1] if model.languages else np.ones(len(texts))
            yield batch.filter(pa.array(letters & (score >= least)))

    return run


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a letter and a language with at least that score.

    If nothing was learned, a letter is enough.
    """
    return docs.mapInArrow(_accept_task(model, least), docs.schema)


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(~held_out())
