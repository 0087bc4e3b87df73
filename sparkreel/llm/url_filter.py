"""URL filters: listed host rules first, then association rules mined from labelled URLs.

Labelled URLs are transactions of tokens (scheme, host parts, path parts, query
keys) with their label. Frequent tokens that occur in exactly the same labelled
URLs are one item, since a rule with any of them has the same figures: the parts
of a common long URL would else be mined in all their combinations. FP-growth
finds frequent combinations of items; those that imply the label `block` with
enough confidence, support and lift become rules. An item is met by a URL with
one of its tokens. Rules sit in an inverted index under the tokens of their
rarest item; a URL looks up its tokens and keeps the rules that it meets whole.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, stored

#: (host, path, verdict); a rule covers its host and all subdomains.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SUPPORT = 0.005
CONFIDENCE = 0.5
LIFT = 1.2
#: A frequent combination has at least this many labelled URLs, however few there are.
LEAST_URLS = 20
#: Rules that travel with the tasks at most; beyond, the index is a shuffled table.
FEW_RULES = 20_000
BLOCK = "label=block"
#: Between the tokens of one item; tokens have none.
_OR = "\n"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, null if none does; ties go to the smaller text."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """array<string> of a URL's different tokens; digits count as #, line breaks as blanks."""
    url = F.translate(url, _OR, " ")
    host, path = host_of(url), path_of(url)
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.when(scheme == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("scheme="), F.lower(scheme)))),
            F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
            F.transform(parts, lambda x: F.concat(F.lit("path="), x)),
            F.transform(keys, lambda x: F.concat(F.lit("query="), x)),
            F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


_RULES = "antecedent array<string>, confidence double, lift double, support double"


def items_of(spread: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """token, item from spread(url, token): tokens of `least` rows or more, and all that have the same rows under one item.

    Tokens with the same number of rows and the same four sums of 31-bit hashes of
    their urls have the same rows. Tokens of `most` rows are left out.
    """
    sums = [F.sum(F.xxhash64(F.lit(i), "url").bitwiseAND(0x7FFFFFFF)).alias(f"s{i}") for i in range(4)]
    frequent = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)
    if most is not None:
        frequent = frequent.where(F.col("n") < most)
    together = frequent.groupBy("n", *[f"s{i}" for i in range(4)]).agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return together.select(F.explode("tokens").alias("token"), F.array_join("tokens", _OR).alias("item"))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least_urls: int = LEAST_URLS) -> DataFrame:
    """antecedent, confidence, lift, support of rules that imply `block`, from labelled(url, bad).

    An antecedent's items are tokens, or tokens with the same labelled urls divided
    by line breaks, of which any one will do. Rows without url or label teach
    nothing. A rule that contains another at least as confident rule is left out.
    With fewer than least_urls labelled urls there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and bad is not null").select("url", "bad", F.monotonically_increasing_id().alias("n"), tokens(F.col("url")).alias("own"))
    rows, rows_at = stored(rows, "labelled")
    n = rows.count()
    if n < least_urls:
        discard(spark, rows_at)
        return spark.createDataFrame([], _RULES)
    share = max(support, least_urls / n)
    spread = rows.select("n", "url", F.explode("own").alias("token"))
    # A token of all labelled urls has a lift of 1.
    items = items_of(spread, share * n, n if lift > 1 else None)
    met = spread.select("n", "token").join(items, "token").groupBy("n").agg(F.collect_set("item").alias("items"))
    none = F.array().cast("array<string>")
    baskets = rows.select("n", "bad").join(met, "n", "left").select(F.concat(F.coalesce("items", none), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(none)).alias("items"))
    baskets = cut(baskets, "baskets")
    discard(spark, rows_at)
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= lift)).select("antecedent", "confidence", "lift", "support")
    # A shorter rule with one item less and no less confidence says the same.
    shorter = rules.select(F.array_sort("antecedent").alias("key"), F.col("confidence").alias("known"))
    drops = rules.select(F.array_sort("antecedent").alias("whole"), "confidence", F.explode("antecedent").alias("x")).select("whole", "confidence", F.array_remove("whole", F.col("x")).alias("key"))
    needless = drops.join(shorter, "key").where("known >= confidence").select(F.col("whole").alias("antecedent")).distinct()
    return rules.withColumn("antecedent", F.array_sort("antecedent")).join(needless, "antecedent", "left_anti")


def index_of(rules: DataFrame) -> DataFrame:
    """anchor, antecedent, confidence, support: each rule under the tokens of that of its items which the fewest rules have."""
    spread = rules.select("*", F.explode("antecedent").alias("item"))
    uses = spread.groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    rarest = spread.join(uses, "item").groupBy("antecedent", "confidence", "support").agg(F.min(F.struct("uses", "item")).alias("rarest"))
    return rarest.select(F.explode(F.split("rarest.item", _OR)).alias("anchor"), "antecedent", "confidence", "support")


def mined_verdicts(urls: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """url, mined, confidence: for each different url the most confident mined rule that it meets."""
    index = cut(index_of(rules), "index")
    index = F.broadcast(index) if index.limit(few + 1).count() <= few else index
    looked_up = urls.where("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("own"))
    meets = F.forall("antecedent", lambda item: F.arrays_overlap(F.split(item, _OR), F.col("own")))
    hits = looked_up.select("url", "own", F.explode("own").alias("anchor")).join(index, "anchor").where(meets)
    said = F.array_join(F.transform("antecedent", lambda item: F.translate(item, _OR, "|")), " ")
    best = F.max(F.struct("confidence", "support", said.alias("rule")))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule").alias("mined"), F.col("best.confidence").alias("confidence"))


def judged_pages(pages: DataFrame, labels: DataFrame, rules: tuple = LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least_urls: int = LEAST_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence for every row of pages(page_id, url).

    The longest listed rule decides; without one the url is blocked if a mined rule
    fits, else allowed. A mined rule needs a share `support` of the labelled urls and
    least_urls of them: fewer say nothing of the others. So below least_urls / support
    labelled urls that floor decides, and below least_urls none is mined. Labels(doc_id,
    quality, toxic) belong to the page with that id: toxic or of quality 0 is bad. A
    page with several labels is bad if one is. A url that is null or has no :// has an
    empty host and path. Other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.bool_or((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    mined = mined_rules(pages.join(bad, "page_id").select("url", "bad"), support, confidence, lift, least_urls)
    verdicts = mined_verdicts(pages, mined)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.join(verdicts, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    rule, said = listed_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined", "confidence")
