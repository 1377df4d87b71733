"""URL filtering: base rules by longest match, and association rules mined from labelled URLs.

A URL's tokens are its scheme-free parts: the host's labels and their words, path segments (numbers as
``<n>``) and query keys. Spark's FP-growth mines the token combinations of labelled
URLs together with their label; rules *tokens => block* are kept by support and confidence, and those that
a shorter kept rule implies are dropped. Before that, tokens that stand in just the same labelled URLs become one class,
named by its least token: a rule on a class stands for the rules on any of its tokens, and a URL has the class if it has any
of them. That is exact, and saves the power sets of tokens that always come together. A class that all labelled URLs have can be
a rule by itself only, as with it no other rule gets shorter or surer.

Rules are matched through an inverted index: each rule is filed under its rarest class, found by a join on the classes of
distinct token sets, and tested whole. DataFrame functions and the library's own FP-growth only.

A host's base rule fits the host and all its subdomains if the path starts with the rule's; the longest
rule string wins. A null URL, or one without ``://``, has an empty host and path and no tokens, hence is allowed.
Repeated ids and rows stay separate rows. Labelled URLs with null labels are not used; without any blocked ones no rules
are mined. Further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import drop, keep

#: (host, path, verdict)
BASE_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
LABEL = "\x00block"
#: Labelled URLs of one partition of FP-growth, and equal ones that are put down as one row before they are dealt out.
BASKETS = 50_000
#: A token set with more than this part of the pages is hot; there are fewer such sets than this number. Their pages are dealt over as many slices.
HOT = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, each with a letter for the part it comes from."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    words = F.split(host, r"[.\-_]")
    segments = F.transform(F.split(path, "[/._-]"), lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("<n>")).otherwise(s))
    keys = F.transform(F.split(query, "[&;]"), lambda p: F.substring_index(p, "=", 1))
    parts = [(labels, "d:"), (words, "h:"), (segments, "p:"), (keys, "q:")]
    return F.array_distinct(F.concat(*(_marked(part, mark) for part, mark in parts)))


def _marked(part: Column, mark: str) -> Column:
    return F.transform(F.array_remove(part, ""), lambda x: F.concat(F.lit(mark), x))


@dataclass
class Rules:
    """``rules``: rule_id, tokens (classes), confidence, support; ``classes``: token, class of every token that rules can hold."""

    rules: DataFrame
    classes: DataFrame


def key_of(tokens: Column) -> Column:
    """A 128-bit name of a token set."""
    return F.unhex(F.md5(F.array_join(F.array_sort(tokens), "\x00")))


def token_classes(baskets: DataFrame, floor: int) -> DataFrame:
    """(token, class, n, b) of the tokens of ``floor`` or more blocked URLs; baskets are (key, tokens, blocked, copies).

    Tokens of one class stand in the same baskets, as two hashes over their keys tell.
    """
    parts = baskets.select("key", "blocked", "copies", F.explode("tokens").alias("token"))
    seen = parts.groupBy("token").agg(
        F.sum("copies").alias("n"), F.sum(F.when(F.col("blocked"), F.col("copies")).otherwise(0)).alias("b"),
        F.bit_xor(F.xxhash64("key", "blocked")).alias("x"), F.bit_xor(F.xxhash64("blocked", "key")).alias("y"),
    )
    useful = seen.where(F.col("b") >= floor)
    named = useful.groupBy("n", "b", "x", "y").agg(F.min("token").alias("class"))
    return useful.join(named, ["n", "b", "x", "y"]).select("token", "class", "n", "b")


def mined_rules(labelled: DataFrame, support: float = 0.0005, confidence: float = 0.8, least: int = 5) -> Rules:
    """Rules from labelled URLs (url, blocked).

    ``support`` is a share of the labelled URLs that any rule must reach, ``least`` a number of them.
    Only tokens of blocked URLs can be part of a rule, so transactions are cut to those that reach the support
    among blocked URLs before anything is mined.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and blocked is not null").select(tokens_of(F.col("url")).alias("tokens"), "blocked")
    rows = rows.where(F.size("tokens") > 0).withColumn("key", key_of(F.col("tokens")))
    baskets = keep(rows.groupBy("key", "blocked").agg(F.any_value("tokens").alias("tokens"), F.count("*").alias("copies")), "baskets")
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    total, blocked = baskets.agg(F.sum("copies"), F.sum(F.when(F.col("blocked"), F.col("copies")))).first()
    floor = math.ceil(max(least, support * (total or 0)) - 1e-9)
    classes = keep(token_classes(baskets, floor), "classes")
    out = classes.select("token", "class")
    if not blocked or classes.isEmpty():
        return Rules(empty, out)
    everywhere = classes.where(F.col("n") == total).select(F.array("class").alias("tokens"), (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / total).alias("support"))
    everywhere = everywhere.where(F.col("confidence") >= confidence).distinct()

    telling = classes.where(F.col("n") < total).select("token", "class")
    items = baskets.select("key", "blocked", "copies", F.explode("tokens").alias("token")).join(telling, "token")
    items = items.groupBy("key", "blocked", "copies").agg(F.array_sort(F.collect_set("class")).alias("items"))
    merged = items.groupBy("items", "blocked").agg(F.sum("copies").alias("copies"))
    size = merged.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    if not size:
        return Rules(everywhere.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support"), out)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / BASKETS))
    labelled_items = F.when(F.col("blocked"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items"))
    shares = merged.select(labelled_items.alias("items"), "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BASKETS).cast("long"))).alias("at"))
    shares = shares.repartition(parts, "items", "at")
    each = shares.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("at"), F.lit(BASKETS)))).alias("copy"))
    model = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / size, minConfidence=confidence, numPartitions=parts).fit(each.select("items"))
    frequent = keep(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    hit = frequent.where(F.array_contains("items", LABEL) & (F.size("items") > 1))
    hit = hit.select(F.array_remove("items", LABEL).alias("items"), F.col("freq").alias("b"))
    sure = hit.join(frequent, "items").withColumn("confidence", F.col("b") / F.col("freq")).where(F.col("confidence") >= confidence)
    found = sure.select(F.col("items").alias("tokens"), "confidence", (F.col("b") / total).alias("support")).unionByName(everywhere)
    found = keep(found.withColumn("rule_id", F.xxhash64("tokens")), "rules")
    drop(baskets, frequent)
    longer = found.where(F.size("tokens") > 1).select("rule_id", "tokens", F.explode("tokens").alias("t"))
    shorter = found.select(F.col("tokens").alias("s"), F.element_at("tokens", 1).alias("t"))
    implied = longer.join(shorter, "t").where((F.size("s") < F.size("tokens")) & (F.size(F.array_except("s", "tokens")) == 0))
    minimal = found.join(implied.select("rule_id").distinct(), "rule_id", "left_anti").select(*empty.columns)
    return Rules(keep(minimal, "minimal"), out)


def matched(token_sets: DataFrame, mined: Rules) -> DataFrame:
    """(key, n_rules, confidence) of the distinct token sets (key, tokens) that meet a rule."""
    parts = token_sets.select("key", F.explode("tokens").alias("token")).join(mined.classes, "token")
    sets = keep(parts.groupBy("key").agg(F.collect_set("class").alias("classes")), "classes")
    often = sets.select(F.explode("classes").alias("class")).groupBy("class").count()
    named = mined.rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("class"))
    ranked = named.join(often, "class", "left").na.fill(0, ["count"])
    index = ranked.groupBy("rule_id", "tokens", "confidence").agg(F.min(F.struct("count", "class"))["class"].alias("class"))
    probes = sets.select("key", "classes", F.explode("classes").alias("class"))
    hits = probes.join(keep(index, "index"), "class").where(F.size(F.array_except("tokens", "classes")) == 0)
    return hits.groupBy("key").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame,
    mined: Rules,
    base: tuple[tuple[str, str, str], ...] = BASE_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict, n_rules, confidence for every row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = rows.withColumn("key", F.when(F.size("tokens") > 0, key_of(F.col("tokens"))))
    sets = keep(rows.where("key is not null").groupBy("key").agg(F.any_value("tokens").alias("tokens"), F.count("*").alias("pages")), "sets")
    total = sets.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = F.broadcast(sets.where(F.col("pages") * HOT > total).select("key", F.lit(True).alias("hot")))
    hits = matched(sets.select("key", "tokens"), mined)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(base, key=lambda r: len(r[0] + r[1])):
        under = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = under & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    every, one = F.sequence(F.lit(0), F.lit(HOT - 1)), F.array(F.lit(0))
    hits = hits.join(hot, "key", "left").withColumn("slice", F.explode(F.when(F.col("hot"), every).otherwise(one))).drop("hot")
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "host", "path"), F.lit(HOT))).otherwise(0).cast("int")
    rows = rows.select("id", "host", "path", "key").join(hot, "key", "left").withColumn("slice", dealt)
    judged = rows.join(hits, ["key", "slice"], "left")
    found = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence",
    )
