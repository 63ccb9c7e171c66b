"""URL filters: host and path rules first, association rules mined by FP-growth for the rest.

Urls that a rule decides are the labelled examples. FP-growth mines
combinations of their tokens together with the decision; rules "tokens imply
decision" are pruned by support, confidence and lift and applied to the other
urls through an inverted index on each rule's rarest token. All of it runs as
DataFrame operations and the JVM's FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

SUPPORT, CONFIDENCE, LONGEST = 0.01, 0.9, 3
BLOCK, ALLOW = "decision=block", "decision=allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the ``rules`` (verdict, host, path) that fits; nulls if none does. Equal lengths: the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])) if rules else []:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments and query keys, each marked by its kind, sorted."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    mark = lambda kind, arr: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    parts = F.concat(
        mark("s:", F.array(ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
        mark("h:", F.split(host, r"\.")),
        mark("p:", F.split(path, "/")),
        mark("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))),
    )
    return F.array_sort(F.array_distinct(parts))


def _alike(rows: DataFrame, support: float) -> DataFrame:
    """(first, of): the frequent items, as classes of those that always occur together, with the first of each.

    A row holds few items of its share of ``1 / support``, so there are few.
    """
    least = math.ceil(support * rows.count())
    each = rows.select(F.monotonically_increasing_id().alias("row"), "items").select("row", F.explode(F.array_distinct("items")).alias("item"))
    prints = each.groupBy("item").agg(F.count("*").alias("c"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("p")).where(F.col("c") >= least)
    found = prints.groupBy("c", "p").agg(F.sort_array(F.collect_list("item")).alias("of"))
    return materialise(found.select(F.col("of")[0].alias("first"), "of"), "url-tokens")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame | None:
    """Rules (antecedent, verdict, confidence, support) from all rows of ``labelled`` (items, verdict); None without rows.

    At most a few items a row can have a support of ``support``, so the number
    of rules is bounded by the parameters and not by the input. Tokens that
    always occur together would multiply the item sets (30 of them make 2^30),
    so one of them is mined for all and the rules are spelled out afterwards,
    up to ``longest`` tokens.
    """
    rows = labelled.select(F.array_append("items", F.concat(F.lit("decision="), "verdict")).alias("items"))
    if rows.isEmpty():
        return None
    alike = _alike(labelled, support)
    names = F.array(*[F.lit(x) for x in [*(r["first"] for r in alike.select("first").collect()), BLOCK, ALLOW]])
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows.select(F.array_intersect("items", names).alias("items")))
    decided = F.element_at("consequent", 1)
    found = model.associationRules.where(decided.isin(BLOCK, ALLOW) & (F.size("antecedent") <= longest) & (F.col("lift") > 1))
    alone = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("first"), "freq")
    grown = alike.select("first", "of", F.explode("of").alias("y")).select("first", "of", F.array("y").alias("part"))
    parts = grown.select("first", "part")
    for _ in range(longest - 1):
        more = F.explode(F.filter("of", lambda y: y > F.element_at("part", -1)))
        grown = grown.select("first", "of", "part", more.alias("y")).select("first", "of", F.array_append("part", F.col("y")).alias("part"))
        parts = parts.union(grown.select("first", "part"))
    parts = materialise(parts, "url-token-choices")
    found = found.select("antecedent", F.substring_index(decided, "=", -1).alias("verdict"), "confidence", "support", F.array().cast("array<string>").alias("spelled"))
    for i in range(longest):  # each item by each choice of the tokens that it stands for
        one = found.where(F.size("antecedent") > i).join(parts, F.col("antecedent")[i] == F.col("first"))
        one = one.select("antecedent", "verdict", "confidence", "support", F.concat("spelled", "part").alias("spelled")).where(F.size("spelled") <= longest)
        found = one.union(found.where(F.size("antecedent") <= i))
    found = found.select(F.array_sort("spelled").alias("antecedent"), "verdict", "confidence", "support")
    of = alike.select(F.explode("of").alias("item"), "first")
    key = found.select("*", F.explode("antecedent").alias("item")).join(of.join(alone, "first"), "item")
    # the rarest token of each rule is its entry in the index
    entry = key.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("entry"))
    return materialise(entry, "url-rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, learned) for distinct token sets ``items``: the rule of the highest confidence, then support, then the first in order."""
    hits = sets.select("items", F.explode("items").alias("entry")).join(rules, "entry").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", "support", F.transform("antecedent", lambda x: x).alias("antecedent"), "verdict"))["verdict"]
    return hits.groupBy("items").agg(best.alias("learned"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns ``keep``, host, path, rule and verdict of every row.

    Urls that no rule decides get the mined rules' verdict, else ``default``.
    Null and odd urls have an empty host and path and few or no tokens;
    repeated rows are judged one by one; an empty table, or one in which no
    rule fits, mines nothing.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(*keep, F.col(url_col).alias("_url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_fixed", verdict).withColumn("_items", tokens(F.col("_url"), F.col("host"), F.col("path"))).drop("_url")
    rows = materialise(rows, "urls")
    mined = mine(rows.where("_fixed is not null").select(F.col("_items").alias("items"), F.col("_fixed").alias("verdict")))
    out = [*keep, "host", "path", "rule"]
    if mined is None:
        return rows.select(*out, F.coalesce("_fixed", F.lit(default)).alias("verdict"))
    # only tokens that some rule asks for tell urls apart, which leaves few different sets
    asked = F.array(*[F.lit(r[0]) for r in mined.select(F.explode("antecedent")).distinct().orderBy("col").collect()]).cast("array<string>")
    rows = rows.withColumn("_items", F.when(F.col("_fixed").isNull(), F.array_intersect("_items", asked)))
    learned = materialise(match(rows.where("_fixed is null").select(F.col("_items").alias("items")).distinct(), mined), "url-verdicts")
    open_ = rows.where("_fixed is null").join(learned, F.col("_items") == F.col("items"), "left").select(*out, F.coalesce("learned", F.lit(default)).alias("verdict"))
    return rows.where("_fixed is not null").select(*out, F.col("_fixed").alias("verdict")).union(open_)
