"""Exact vector search, pattern selection, rank fusion, domain consensus and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import dot, holds_all, significant_tokens

RRF_K, LEXICAL_DEPTH, VECTOR_DEPTH = 60, 100, 50
FLOOR, WINDOW, CAP = 0.70, 0.12, 25
HEAD, DEMOTION, QUORUM = 10, 0.75, 3


def similarity(patterns: DataFrame, vector: Column) -> DataFrame:
    return patterns.withColumn("sim", dot(F.col("embedding"), vector))


def nearest(patterns: DataFrame, vector: Column, k: int) -> DataFrame:
    """(pattern, rank, sim) of the k nearest, exactly."""
    top = similarity(patterns, vector).orderBy(F.desc("sim"), "pattern").limit(k)
    return top.select("pattern", F.row_number().over(W.orderBy(F.desc("sim"), "pattern")).alias("rank"), "sim")


def collapsed(scored: DataFrame, by: str, k: int = 400, size: int = 10, tie: tuple[str, ...] = ("key",)) -> DataFrame:
    """The best of each ``by`` among the ``k`` rows of the highest ``sim``, at most ``size`` of them, ranked. Groups are formed after the k rows are chosen."""
    order = [F.desc("sim"), *tie]
    top = scored.orderBy(*order).limit(k)
    best = top.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where("_r = 1").drop("_r")
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") <= size)


def select_patterns(patterns: DataFrame, vector: Column, topic: Column, floor: float = FLOOR, window: float = WINDOW, cap: int = CAP) -> DataFrame:
    """(pattern, sim, via, rank): patterns near the best similarity, or that hold every significant word of the topic; the nearest ``cap``."""
    x = similarity(patterns, vector)
    best = x.agg(F.max("sim").alias("best"))
    x = x.join(F.broadcast(best)).withColumn("limit", F.greatest(F.lit(floor), F.col("best") - window))
    near, lexical = F.col("sim") >= F.col("limit"), holds_all(F.col("pattern"), significant_tokens(topic))
    x = x.where(near | lexical).withColumn("via", F.when(near, "vector").otherwise("lexical")).orderBy(F.desc("sim"), "pattern").limit(cap)
    return x.select("pattern", F.round("sim", 4).alias("sim"), "via", F.row_number().over(W.orderBy(F.desc("sim"), "pattern")).alias("rank"))


def ranked(scored: DataFrame, k: int, key: str = "pattern") -> DataFrame:
    """(key, rank) of the k best scores, ties by key."""
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.select(key, F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"))


def fuse(*legs: DataFrame, k: int = RRF_K, key: str = "pattern") -> DataFrame:
    """(key, rrf, place, rank_0, rank_1, ...): reciprocal rank fusion. Equal scores keep the order in which they first appear, leg by leg."""
    rows = None
    for i, leg in enumerate(legs):
        one = leg.select(key, "rank", F.lit(i).alias("leg"))
        rows = one if rows is None else rows.unionByName(one)
    ranks = [F.max(F.when(F.col("leg") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(legs))]
    x = rows.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("leg", "rank")).alias("seen"), *ranks)
    order = W.orderBy(F.round("rrf", 12).desc(), "seen.leg", "seen.rank", key)
    return x.select(key, "rrf", F.row_number().over(order).alias("place"), *[f"rank_{i}" for i in range(len(legs))])


def consensus(fused: DataFrame, patterns: DataFrame, head: int = HEAD, demotion: float = DEMOTION, quorum: int = QUORUM) -> DataFrame:
    """``fused`` with domain, agreed (the domain that the head's rank-weighted vote elects), score and a new place.

    Patterns of another or no domain are demoted. Without a quorum of patterns
    or any vote nothing changes.
    """
    x = fused.join(patterns.select("pattern", "domain"), "pattern", "left")
    votes = x.where((F.col("place") <= head) & F.col("domain").isNotNull()).groupBy("domain").agg(F.sum(1 / F.col("place")).alias("v"), F.min("place").alias("p"))
    winner = votes.agg(F.max_by("domain", F.struct(F.round("v", 12), -F.col("p"))).alias("agreed"))
    size = fused.agg(F.count("*").alias("n"))
    x = x.join(F.broadcast(winner)).join(F.broadcast(size)).withColumn("agreed", F.when(F.col("n") >= quorum, F.col("agreed")))
    same = F.coalesce(F.col("domain") == F.col("agreed"), F.lit(False))
    x = x.withColumn("score", F.when(F.col("agreed").isNull() | same, F.col("rrf")).otherwise(F.col("rrf") * demotion))
    return x.withColumn("before", F.col("place")).withColumn("place", F.row_number().over(W.orderBy(F.round("score", 12).desc(), "before"))).drop("n", "before")


def representatives(scored: DataFrame, records: DataFrame, size: int = 10, tie: tuple[str, ...] = ("key",)) -> DataFrame:
    """The latest record of each of the first ``2 size`` patterns, the first ``size`` that have one, in order.

    records come filtered. Candidates are few and broadcast, so records are
    scanned once and only the latest per candidate is kept.
    """
    candidates = scored.where(F.col("place") <= 2 * size)
    line = W.partitionBy("pattern").orderBy(F.col("created").desc_nulls_last(), *tie)
    latest = records.join(F.broadcast(candidates.select("pattern")), "pattern", "left_semi").withColumn("_r", F.row_number().over(line)).where("_r = 1").drop("_r")
    return candidates.join(latest, "pattern").orderBy("place").limit(size)
