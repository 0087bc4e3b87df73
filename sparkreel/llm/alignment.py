"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Both tokenizers break before a blank that follows a character that is not white
space. Texts are cut there into units, each different unit is encoded and aligned
once in a task, and a text is the sequence of its units.

1. Links are counted: tasks combine equal id pairs, packed into one int64 each;
   the partial counts are dealt to ranges of keys, sorted and summed in runs.
2. The sorted counts become shards that tasks map into memory. The highest count
   of each id of the second tokenizer is a table of its vocabulary's size.
3. Texts are read again, and their links' counts looked up by binary search.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shards import Shards, Tally, opened, run_lengths, written

SHARD_ROWS = 2_000_000
#: Characters of the units that a task remembers at most, and of texts that it encodes at once.
REMEMBERED = 8_000_000
SLICE = 2_000_000
_CUT = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """Pieces of a blank and text, each without its first blank; tokens of either kind never reach over their borders."""
    if _WIDE.search(text) or text[:1] == " ":
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids and bytes of a byte-level BPE vocabulary file, without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, letters = content["model"]["vocab"], byte_letters()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        special = {t["content"] for t in content.get("added_tokens", ())}
        for token, number in vocabulary.items():
            if token not in special:
                self.bytes[number] = bytes(letters[c] for c in token)
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in content["model"]["merges"]]
        split = content.get("pre_tokenizer") or {}
        if merged == sorted(merged) and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
            # Ids in the order of merges are ranks, which need no library of merges.
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            # A task has one core; threads of the library would only wait for each other.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            encoder.encode_special_tokens = True
            self.encode = lambda text: encoder.encode(text, add_special_tokens=False).ids

    def unit(self, u: str) -> list[int]:
        return self.encode(" " + u)

    def joined(self, some: list[str]) -> list[int]:
        return self.encode(" " + " ".join(some))


class Pieces:
    """Ids and bytes of a piece model that puts a blank before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = SentencePieceProcessor(model_file=path)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.vocab_size())]
        self.blank = pieces.index("▁")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def unit(self, u: str) -> list[int]:
        # Alone, an empty unit would be an empty text; after others it is a blank.
        return self.encoder.encode(u, num_threads=1) if u else [self.blank]

    def joined(self, some: list[str]) -> list[int]:
        # The library slows down on long texts; every part gets its first blank by itself.
        parts = [" ".join(some[i : i + 32]) for i in range(0, len(some), 32)]
        return list(chain.from_iterable(self.encoder.encode(parts, num_threads=1)))


class _Table:
    """What a codec's ids are in bytes and in digits."""

    def __init__(self, codec: ByteLevel | Pieces):
        self.codec = codec
        self.sizes = np.array([len(x) for x in codec.bytes], np.int64)
        self.digits = [[f"{i}{sign}" for i in range(len(codec.bytes))] for sign in ",|;"]


@lru_cache(maxsize=2)
def _codecs(first: str, second: str) -> tuple[_Table, _Table]:
    return _Table(ByteLevel(first)), _Table(Pieces(second))


class Side:
    """One tokenizer's tokens of many units, one after the other."""

    def __init__(self, table: _Table, ids: np.ndarray, stops: np.ndarray):
        """stops: where units end in bytes."""
        self.table, self.ids = table, ids
        self.ends = np.cumsum(table.sizes[ids])
        self.per_unit = np.diff(np.r_[0, np.searchsorted(self.ends, stops, "right")])

    def digits(self, sign: np.ndarray) -> list[str]:
        return [self.table.digits[s][i] for s, i in zip(sign.tolist(), self.ids.tolist(), strict=True)]


class Aligned:
    """Units that both tokenizers spell as they are: tokens, groups and links, one unit after the other."""

    def __init__(self, a: Side, b: Side, stops: np.ndarray, written: bool):
        self.n_a, self.n_b = a.per_unit, b.per_unit
        ends = np.sort(np.concatenate([a.ends, b.ends]), kind="stable")
        again = ends[1:] == ends[:-1]
        every, common = ends[np.r_[True, ~again]] if len(ends) else ends, ends[1:][again]
        self.pairs = a.ids[np.searchsorted(a.ends, every)] << 32 | b.ids[np.searchsorted(b.ends, every)]
        self.pair_unit = np.searchsorted(stops, every)
        self.n_links = np.bincount(self.pair_unit, minlength=len(stops))
        self.n_groups = np.bincount(np.searchsorted(stops, common), minlength=len(stops))
        self.groups = self._written(a, b, common) if written else []

    def _written(self, a: Side, b: Side, common: np.ndarray) -> list[str]:
        """Each unit's groups as text, every group ended by a semicolon."""
        groups = [np.searchsorted(common, side.ends) for side in (a, b)]
        last = [np.r_[g[1:] != g[:-1], True][: len(g)] for g in groups]
        text = [side.digits(np.where(at, i + 1, 0)) for i, (side, at) in enumerate(zip((a, b), last, strict=True))]
        # Tokens by group, the first tokenizer's before the second's.
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable").tolist()
        text = list(map((text[0] + text[1]).__getitem__, order))
        cuts = np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        return ["".join(text[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


class Known:
    """Units seen so far in a task, each aligned once."""

    def __init__(self, first: str, second: str, written: bool):
        """written: with the groups as text."""
        self.tables, self.written = _codecs(first, second), written
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.size = 0
        self.good = np.empty(0, bool)
        self.parts: list[Aligned | int] = []

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[Aligned | int]]:
        """(units of all texts, where each text's begin, what is new); null and empty texts have no unit."""
        split = [units(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        before = len(self.parts)
        fresh = [u for u in dict.fromkeys(flat) if u not in self.at]
        # Units that end in white space would run into the next one, and U+2581 is spelled as a blank.
        plain = [u for u in fresh if u and not u[-1].isspace() and "▁" not in u]
        if plain and not self._add_joined(plain):
            self._add_each(plain)
        if len(plain) < len(fresh):
            some = set(plain)
            self._add_each([u for u in fresh if u not in some])
        cuts = np.cumsum([0, *map(len, split)])
        return np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat)), cuts, self.parts[before:]

    def _add_joined(self, some: list[str]) -> bool:
        """Units encoded as one text; False if that is not spelled by its tokens."""
        whole = (" " + " ".join(some)).encode()
        ids = [np.array(t.codec.joined(some), np.int64) for t in self.tables]
        if any(b"".join(map(t.codec.bytes.__getitem__, i.tolist())) != whole for t, i in zip(self.tables, ids, strict=True)):
            return False
        stops = np.cumsum(_sizes(some))
        self._keep(some, Aligned(*map(partial(Side, stops=stops), self.tables, ids), stops, self.written))
        return True

    def _add_each(self, some: list[str]) -> None:
        found = [[np.array(t.codec.unit(u), np.int64) for u in some] for t in self.tables]
        spelled = [[b"".join(map(t.codec.bytes.__getitem__, i.tolist())) for i in x] for t, x in zip(self.tables, found, strict=True)]
        good = [x == y == (" " + u).encode() for u, x, y in zip(some, *spelled, strict=True)]
        kept = [u for u, g in zip(some, good, strict=True) if g]
        if kept:
            stops = np.cumsum(_sizes(kept))
            ids = [np.concatenate([i for i, g in zip(x, good, strict=True) if g]) for x in found]
            self._keep(kept, Aligned(*map(partial(Side, stops=stops), self.tables, ids), stops, self.written))
        if len(kept) < len(some):
            self._keep([u for u, g in zip(some, good, strict=True) if not g], None)

    def _keep(self, some: list[str], made: Aligned | None) -> None:
        """made: None for units that are spelled otherwise, which have no tokens; of those, parts has the number."""
        self.at.update(zip(some, range(len(self.at), len(self.at) + len(some)), strict=True))
        self.size += sum(map(len, some)) + 8 * len(some)
        self.good = np.r_[self.good, np.full(len(some), made is not None)]
        self.parts.append(len(some) if made is None else made)


def _sizes(some: list[str]) -> list[int]:
    """Bytes of units with their blanks."""
    return [len(u.encode()) + 1 for u in some]


def _slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _ok(good: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether a text has units, and only good ones."""
    bad = np.r_[0, np.cumsum(~good)]
    return (bad[cuts[1:]] == bad[cuts[:-1]]) & (cuts[1:] > cuts[:-1])


def _count_task(first: str, second: str, remembered: int):
    """Partial counts (key, n) of linked id pairs."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 100_000):
            yield pa.record_batch([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally, seen = Known(first, second, False), Tally(), np.zeros(0, np.int64)

        def linked() -> Iterator[pa.RecordBatch]:
            start = 0
            for part in known.parts:
                if isinstance(part, int):
                    start += part
                    continue
                counts = seen[start : start + len(part.n_a)][part.pair_unit]
                start += len(part.n_a)
                keys, back = np.unique(part.pairs[counts > 0], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, back, counts[counts > 0])
                for full in tally.add(keys, sums):
                    yield from rows(*full)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                codes, cuts, _ = known.codes(texts[a:b])
                good = np.repeat(_ok(known.good[codes], cuts), np.diff(cuts))
                seen = np.bincount(codes[good], minlength=len(known.at)) + np.r_[seen, np.zeros(len(known.at) - len(seen), np.int64)]
                if known.size > remembered:
                    yield from linked()
                    known.forget()
                    seen = np.zeros(0, np.int64)
        yield from linked()
        yield from rows(*tally.combined())

    return run


_DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _digest_task(first: str, second: str, counts: Shards, best: np.ndarray, remembered: int):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table, groups = Known(first, second, True), np.zeros((len(names), 0), np.int64), []
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in _slices(texts):
                codes, cuts, made = known.codes(texts[a:b])
                for part in made:
                    if isinstance(part, int):
                        table, groups = np.pad(table, ((0, 0), (0, part))), groups + [""] * part
                        continue
                    found = counts.values(part.pairs, "n")
                    top = found == best[part.pairs & 0xFFFFFFFF]
                    total = np.zeros(len(part.n_a), np.int64)
                    np.add.at(total, part.pair_unit, found)
                    rows = np.stack([part.n_a, part.n_b, part.n_groups, part.n_links, np.bincount(part.pair_unit[top], minlength=len(part.n_a)), total])
                    table, groups = np.concatenate([table, rows], axis=1), groups + part.groups
                ok = _ok(known.good[codes], cuts)
                upto = np.concatenate([np.zeros((len(names), 1), np.int64), np.cumsum(table[:, codes], axis=1)], axis=1)
                sums = (upto[:, cuts[1:]] - upto[:, cuts[:-1]]) * ok
                digests = [hashlib.sha256("".join(map(groups.__getitem__, codes[x:y].tolist()))[:-1].encode()).hexdigest() if g else "" for x, y, g in zip(cuts[:-1].tolist(), cuts[1:].tolist(), ok.tolist(), strict=True)]
                yield pa.record_batch([ids.slice(a, b - a), *map(pa.array, sums), pa.array(digests, pa.string())], names=["doc_id", *names, "groups_sha256"])
                if known.size > remembered:
                    known.forget()
                    table, groups = table[:, :0], []

    return run


def pair_counts(docs: DataFrame, first: str, second: str, shard_rows: int = SHARD_ROWS, remembered: int = REMEMBERED) -> Shards:
    """Shards of (key, n): how many links of docs(text) hold the ids key >> 32 of the first and key & 0xffffffff of the second tokenizer."""
    partial, _ = stored(docs.select("text").mapInArrow(_count_task(first, second, remembered), "key long, n long"), "pairs")
    ordered = partial.repartitionByRange(partial.count() // shard_rows + 1, "key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(run_lengths(), "key long, n long"), "pair-counts")


def best_counts(spark, counts: Shards, size: int) -> np.ndarray:
    """The highest count of each id of the second tokenizer; the driver gets one number for each, at most its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                most = np.zeros(size, np.int64)
                np.maximum.at(most, opened(path)["key"] & 0xFFFFFFFF, opened(path)["n"])
                ids = np.flatnonzero(most)
                yield pa.record_batch([pa.array(ids), pa.array(most[ids])], names=["id", "n"])

    best = np.zeros(size, np.int64)
    if counts.paths:
        files = spark.createDataFrame([(p,) for p in counts.paths], "path string").repartition(len(counts.paths))
        for number, most in files.mapInArrow(run, "id long, n long").groupBy("id").agg(F.max("n")).collect():
            best[number] = most
    return best


def aligned(docs: DataFrame, first: str, second: str, shard_rows: int = SHARD_ROWS, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs(doc_id, text).

    first: file of a byte-level BPE vocabulary, which encodes a blank and the text;
    second: file of a piece model, which adds the blank itself. Special tokens are
    not encoded; their strings are plain text. Null or empty texts, and those whose
    tokens do not spell the text's bytes, have no tokens: zeros and ''. Repeated
    rows count each time, ids may be null or repeated, other columns are not read.
    Both files must be there on every machine.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = pair_counts(docs, first, second, shard_rows, remembered)
    best = best_counts(docs.sparkSession, counts, len(Pieces(second).bytes))
    return docs.mapInArrow(_digest_task(first, second, counts, best, remembered), _DIGESTS)
