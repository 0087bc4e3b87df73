"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are entities that fixed patterns find and checks confirm. A lexical
pattern is what stands around an entity in the text: the word before it, or the
words before and after it, whatever they hold; where an entity begins or ends
inside a word, the rest of that word. Candidates are other single words with
digits. Patterns and values form a graph that is scored in rounds:

- a pattern's score for a kind is the summed score of its values of that kind
  over the number of its different values, if enough different values support it;
- a value's score is that of at least one of its trusted patterns being right.

Values scored high enough support patterns in the next round, until no pattern or
value is new and the scores stand still. Then every candidate in the context of a
trusted pattern is a span of the pattern's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import EDGES_A_TASK, cut, discard, stored

KINDS = ("email", "ip", "card", "phone")
#: Least score of a trusted pattern or value, and least number of different values that support a pattern.
TRUST = 0.8
SUPPORT = 3
#: Scores only grow from round to round; a sum that grows by no more stands still.
STILL = 1e-6
#: Neighbouring words of more characters are compared by their SHA-256.
CONTEXT = 64
_BLANK = r"[\x20\x09-\x0D]+"

# The contract's patterns. A match can only begin where a run of its first class
# begins or where the last match ended; saying so keeps long runs linear.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "word": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weighed(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weighed(i))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def confirmed(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "ip", _octets(value))
        .when(kind == "card", _luhn(value))
        .when(kind == "phone", F.length(_digits(value)).between(9, 15))
        .otherwise(True)
    )


def _pieces(text: Column) -> Column:
    """The words of a text; the first or last is empty where blanks begin or end it."""
    return F.split(text, _BLANK, -1)


def _found(text: Column, kind: str) -> Column:
    """array<struct> of a pattern's matches, each with length, runs of blanks and last piece's length of the gap before it."""
    pattern = PATTERNS[kind]
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    pairs = F.transform(F.filter(pairs, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.char_length(x["g"]).alias("gap"), _pieces(x["g"]).alias("pieces"), x["m"].alias("value")))
    rows = F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].cast("long").alias("gap"), (F.size(x["pieces"]) - 1).cast("long").alias("blanks"), F.char_length(F.element_at(x["pieces"], -1)).alias("tail"), x["value"].alias("value")))
    mark = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(mark, rows).otherwise(F.array())


def _key(docs: DataFrame) -> list[Column]:
    """A row's 128-bit key: equal rows (id and text) share it, and nulls are values of their own."""
    return [F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2")]


def _neighbours(docs: DataFrame) -> DataFrame:
    """k1, k2, at, word, previous, next of the words in which a match can begin or end; at counts words from 0."""

    def around(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike("[0-9@+]"))
        return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.get(words, i).alias("word"), F.coalesce(F.get(words, i - 1), F.lit("")).alias("previous"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("next")))

    # An array of one, so that the words are split once.
    rows = docs.where(F.col("text").rlike("[0-9@+]")).select(*_key(docs), F.transform(F.array(_pieces(F.col("text"))), around).alias("around"))
    return rows.select("k1", "k2", F.explode(F.flatten("around")).alias("x")).select("k1", "k2", "x.*").dropDuplicates(["k1", "k2", "at"])


def matches(docs: DataFrame) -> DataFrame:
    """k1, k2, kind, start, stop, value, left, right of all matches, before any check. Places are code points.

    No match begins or ends with a blank, so runs of blanks before a match count the words before it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*_key(docs), F.concat(*[_found(text, kind) for kind in PATTERNS]).alias("found"))
    rows = rows.where(F.size("found") > 0).select("k1", "k2", F.posexplode("found").alias("n", "f")).select("k1", "k2", "n", "f.*")
    rows = rows.dropDuplicates(["k1", "k2", "n"])
    order = Window.partitionBy("k1", "k2", "kind").orderBy("n")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", (F.size(_pieces(F.col("value"))) - 1).cast("long")).withColumn("end", F.char_length(F.element_at(_pieces(F.col("value")), -1)))
    rows = rows.select("*", F.sum(F.col("gap") + F.char_length("value")).over(so_far).alias("stop"), F.sum(F.col("blanks") + F.col("inner")).over(so_far).alias("last"))
    rows = rows.withColumn("start", F.col("stop") - F.char_length("value"))
    # Where the words begin that hold the match's first and last character.
    head = F.greatest(F.lit(0), F.max(F.when(F.col("blanks") > 0, F.col("start") - F.col("tail"))).over(so_far), F.max(F.when(F.col("inner") > 0, F.col("stop") - F.col("end"))).over(before))
    rows = rows.select("k1", "k2", "kind", "start", "stop", "value", (F.col("last") - F.col("inner")).alias("first"), "last", "inner", "end", head.alias("head"))
    into = (F.col("start") - F.col("head")).cast("int")
    done = F.when(F.col("inner") > 0, F.col("end")).otherwise(F.col("stop") - F.col("head")).cast("int")

    def said(word: Column) -> Column:
        word = F.lower(word)
        return F.when(F.char_length(word) > CONTEXT, F.sha2(word, 256)).otherwise(word)

    # One side after the other: between the joins a row has its context, not the whole word around it.
    words = _neighbours(docs)
    left = F.when(into > 0, F.substring("word", F.lit(1), into)).otherwise(F.col("previous"))
    rows = rows.join(words.select("k1", "k2", F.col("at").alias("first"), "word", "previous"), ["k1", "k2", "first"], "left")
    rows = rows.select("k1", "k2", "kind", "start", "stop", "value", "last", done.alias("done"), said(left).alias("left"))
    right = F.when(F.char_length("word") > F.col("done"), F.substring("word", F.col("done") + 1, F.char_length("word"))).otherwise(F.col("next"))
    rows = rows.join(words.select("k1", "k2", F.col("at").alias("last"), "word", "next"), ["k1", "k2", "last"], "left")
    return rows.select("k1", "k2", "kind", "start", "stop", "value", "left", said(right).alias("right"))


def _candidates(found: DataFrame, base: DataFrame) -> DataFrame:
    """Digit words, without punctuation at their ends, that touch no base span."""
    words = found.where("kind = 'word'")
    head = F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*", 0))
    core = F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}\p{N}]+", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    words = words.select("k1", "k2", F.lit("word").alias("kind"), (F.col("start") + head).alias("start"), (F.col("start") + head + F.char_length(core)).alias("stop"), core.alias("value"), "left", "right")
    both = words.unionByName(base)
    seeded = F.col("kind") != "word"
    # Both frames begin at an end of the text: one that ends at the other end is summed anew for every row.
    sides = (F.col("start"), F.col("kind") == "word"), (F.col("start").desc(), (F.col("kind") == "word").desc())
    past, coming = (Window.partitionBy("k1", "k2").orderBy(*side).rowsBetween(Window.unboundedPreceding, -1) for side in sides)
    reach = F.max(F.when(seeded, F.col("stop"))).over(past)
    ahead = F.min(F.when(seeded, F.col("start"))).over(coming)
    free = both.withColumn("reach", reach).withColumn("ahead", ahead).where(~seeded & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("ahead") >= F.col("stop"), F.lit(True))))
    return free.drop("reach", "ahead")


def _patterns() -> Column:
    """A row's patterns; none without a word before the entity."""
    both = F.concat_ws(" ", F.lit("B"), "left", "right")
    return F.when(F.col("left") == "", F.array().cast("array<string>")).when(F.col("right") == "", F.array(F.concat_ws(" ", F.lit("L"), "left"))).otherwise(F.array(F.concat_ws(" ", F.lit("L"), "left"), both))


def trusted_patterns(base: DataFrame, candidates: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, score of the patterns trusted in the end.

    Scores only grow, so the set of patterns has settled once a round adds none and
    their sum stands still. Tables of a round hold patterns, not matches: few files.
    """
    seeds = base.select("value", "kind").distinct()
    edges = base.unionByName(candidates).select(F.explode(_patterns()).alias("pattern"), "value").distinct()
    edges, graph = stored(edges, "graph")
    parts = edges.count() // EDGES_A_TASK + 1
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
    seeded = edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).cast("double").alias("good"), F.count(F.lit(1)).alias("support"))
    seeded, first = stored(seeded.coalesce(parts), "seeded")
    goods, last, before = seeded, None, None
    while True:
        judged = goods.groupBy("pattern", "kind").agg(F.sum("good").alias("good"), F.sum("support").alias("support")).where(F.col("support") >= support)
        patterns = judged.join(sizes, "pattern").select("pattern", "kind", F.round(F.col("good") / F.col("values"), 9).alias("score")).where(F.col("score") >= trust)
        patterns, path = stored(patterns.coalesce(parts), "patterns")
        if last:
            discard(edges.sparkSession, last)
        now, last = tuple(patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()), path
        if before is not None and now[0] == before[0] and now[1] - before[1] <= STILL:
            for path in (graph, first):
                discard(edges.sparkSession, path)
            return patterns
        before = now
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        values = edges.join(patterns, "pattern").groupBy("value", "kind").agg(F.round(1 - wrong, 9).alias("score")).where(F.col("score") >= trust)
        fresh = edges.join(values.join(seeds, ["value", "kind"], "left_anti"), "value").select("pattern", "kind", F.col("score").alias("good"), F.lit(1).cast("long").alias("support"))
        goods = seeded.unionByName(fresh)


def personal_data(docs: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for every row of docs(doc_id, text).

    The counts and base_sha256 cover the base spans, spans also those that the
    patterns add (n_found of them). A span is kind:start:stop in code points, stop
    exclusive; spans are sorted by start, then kind as in KINDS, and joined by
    commas. Null text counts as empty. Ids may be null or repeated: each row has
    its own result, equal rows equal ones. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(matches(docs), "matches")
    base = found.where("kind <> 'word'").where(confirmed(F.col("kind"), F.col("value")))
    candidates = cut(_candidates(found, base), "candidates")
    patterns = trusted_patterns(base, candidates, trust, support)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    best = (
        candidates.select("k1", "k2", "start", "stop", F.explode(_patterns()).alias("pattern")).join(patterns, "pattern")
        .withColumn("rank", rank).groupBy("k1", "k2", "start", "stop").agg(F.max(F.struct("score", -F.col("rank"))).alias("best"))
        .select("k1", "k2", "start", "stop", F.element_at(F.array(*map(F.lit, KINDS)), (-F.col("best.col2")).cast("int")).alias("kind"), F.lit(False).alias("base"))
    )
    spans = base.select("k1", "k2", "start", "stop", "kind", F.lit(True).alias("base")).unionByName(best).withColumn("rank", rank)
    lists = spans.groupBy("k1", "k2").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        F.count_if(~F.col("base")).alias("n_found"),
        F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind", "base"))).alias("list"),
    )

    def said(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    rows = docs.select("doc_id", *_key(docs)).join(lists, ["k1", "k2"], "left")
    own = F.coalesce(said(F.filter("list", lambda s: s["base"])), F.lit(""))
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", *[F.coalesce(f"n_{kind}", zero).alias(f"n_{kind}") for kind in KINDS], F.sha2(own, 256).alias("base_sha256"), F.coalesce(said(F.col("list")), F.lit("")).alias("spans"), F.coalesce("n_found", zero).alias("n_found"))
