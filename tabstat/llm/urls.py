"""URL filters: listed rules first, mined association rules for the rest, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.llm import spread as S

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.5
#: Fewest bad pages behind a mined rule, however few pages are labelled.
MIN_PAGES = 5
#: Most tokens of all rules that are broadcast; more are joined.
BROADCAST_TOKENS = 100_000
_BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, up to ? or #; empty without ://. Plain searches: a pattern that recurses would end the JVM on a long url."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.substring_index(_after_scheme(url), "/", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = _after_scheme(url)
    return F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels as h:..., the path's words as p:..."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one text) and its verdict; nulls if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def mine(pages: DataFrame, labels: DataFrame, scratch: S.Scratch, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Token combinations whose labelled pages are mostly bad, as rules over kinds of tokens.

    pages: key, host, path; labels: key, bad (boolean). Returns the rules
    (``antecedent``: kinds, ``confidence``, ``support``) and the kinds of tokens
    (token, kind, n: labelled pages). Tokens of the same labelled pages are one kind:
    each of them alone says as much as all together, so a rule asks for one token of
    each of its kinds. A kind that is bad enough alone is a rule, and its supersets
    add nothing; FP-growth runs distributed on the other kinds that enough bad pages
    have. Rules of any length are pruned by support and confidence alone.
    """
    marked = scratch.table(pages.join(labels, "key").select(F.monotonically_increasing_id().alias("row"), "bad", tokens_of(F.col("host"), F.col("path")).alias("tokens")))
    least = max(min_support * marked.count(), min_pages)
    tokens = marked.select("row", "bad", F.explode("tokens").alias("token"))
    sign = lambda *c: F.sum(F.xxhash64("row", *c).cast("decimal(20,0)"))
    by_token = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), sign().alias("x"), sign(F.lit(1)).alias("y")).where(F.col("b") >= least)
    kinds = scratch.table(by_token)
    kinds = scratch.table(kinds.join(kinds.groupBy("n", "b", "x", "y").agg(F.min("token").alias("kind")), ["n", "b", "x", "y"]).select("token", "kind", "n", "b"))
    own = kinds.where("token = kind").select("kind", "n", "b")
    enough = F.col("b") >= F.col("n") * min_confidence
    alone = own.where(enough).select(F.array("kind").alias("antecedent"), (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / F.lit(max(1, marked.count()))).alias("support"))
    rest = own.where(~enough).select(F.col("kind").alias("token"))
    baskets = tokens.join(rest, "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items"))
    baskets = scratch.table(baskets.select(F.concat("items", F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
    n = baskets.count()
    if not n:
        return alone, kinds
    # Half a page less, as the product with the count is rounded up.
    found = FPGrowth(itemsCol="items", minSupport=max(0.0, (math.ceil(least) - 0.5) / n)).fit(baskets).freqItemsets
    bad = found.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", _BAD)).alias("antecedent"), F.col("freq").alias("b"))
    every = found.where(~F.array_contains("items", _BAD)).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n"))
    longer = bad.join(every, "antecedent").where(enough).select("antecedent", (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / F.lit(marked.count())).alias("support"))
    return alone.union(longer), kinds


def matches(pages: DataFrame, rules: DataFrame, kinds: DataFrame, scratch: S.Scratch) -> DataFrame:
    """Keys of the pages that hold a token of every kind of some rule.

    An inverted index lists each rule under its rarest kind on labelled pages, so
    that no common token (a scheme or a top domain) gathers the pages of every rule.
    The tokens of all rules are broadcast while they are few.
    """
    rules = scratch.table(rules.withColumn("rule", F.monotonically_increasing_id()))
    index = rules.select("rule", "antecedent", F.explode("antecedent").alias("kind"))
    used = scratch.table(kinds.join(index.select("kind").distinct(), "kind").select("token", "kind", "n"))
    rare = index.join(used.select("kind", "n").distinct(), "kind").groupBy("rule").agg(F.first("antecedent").alias("antecedent"), F.min_by("kind", F.struct("n", "kind")).alias("kind"))
    index = scratch.table(rare.groupBy("kind").agg(F.collect_list("antecedent").alias("rules")))
    few = used.count() <= BROADCAST_TOKENS
    near = F.broadcast if few else lambda x: x
    tokens = pages.select("key", F.explode("tokens").alias("token")).join(near(used.select("token", "kind")), "token")
    held = tokens.groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    held = held.select("key", "kinds", F.explode("kinds").alias("kind")).join(near(index), "kind")
    return held.where(F.exists("rules", lambda r: F.size(F.array_except(r, F.col("kinds"))) == 0)).select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", *, label_id_col: str = "doc_id", rules: Sequence[tuple[str, str, str]] = RULES, **how) -> DataFrame:
    """Verdict of every url.

    Returns one row per page: ``id``, ``host``, ``path``, ``rule`` (the longest
    listed rule that fits, else null), ``verdict`` (allow or block) and ``mined``
    (whether a mined rule matches). The listed rule decides; without one, a page is
    blocked when a mined rule matches. labels has an id and quality, toxic (0 or
    1); a page is bad if quality is 0 or toxic is 1.

    Null urls and urls without :// have an empty host and path, no rule and no
    tokens: they are allowed. Null ids are judged but never labelled. Repeated rows
    each get their row; a page labelled more than once is bad if any label says so.
    Empty labels mine nothing. Other columns are not read.
    """
    parsed = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("id", "host", "path", name.alias("rule"), verdict.alias("listed"))
    bad = labels.groupBy(labels[label_id_col].alias("id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).where("id IS NOT NULL")
    scratch = S.Scratch(pages.sparkSession)
    mined, kinds = mine(parsed.select(F.col("id").alias("key"), "host", "path").where("host <> ''"), bad.withColumnRenamed("id", "key"), scratch, **how)
    # Pages with one host and path have one verdict: matching works on distinct urls.
    urls = parsed.select("host", "path").where("host <> '' OR path <> ''").distinct().select(F.struct("host", "path").alias("key"), tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    hit = scratch.keep(scratch.table(matches(urls, mined, kinds, scratch).select("key.host", "key.path", F.lit(True).alias("hit"))))
    scratch.free()
    out = parsed.join(hit, ["host", "path"], "left")
    found = F.coalesce("hit", F.lit(False))
    return out.select("id", "host", "path", "rule", F.coalesce("listed", F.when(found, "block").otherwise("allow")).alias("verdict"), found.alias("mined"))
