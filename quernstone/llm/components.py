"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, materialise, rehash, sweep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v). Minima come from a partial aggregation; no neighbour list is gathered."""
    both = edges.union(edges.select("v", "u"))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    low = low.select(rehash("k").alias("k"), "m")
    joined = both.join(low, F.col("u") == F.col("k"))
    if large:
        new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m"))
    return new.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint), component being the smallest node reachable.

    Self loops and nulls count as no edge; nodes without an edge don't appear.
    Each round is written to the shared folder, so a lost executor repeats at
    most one round; a round that the next has replaced is deleted. Ends when a
    round changes nothing.
    """
    spark, since = edges.sparkSession, mark()
    e = materialise(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        e = materialise(_stars(_stars(e, True), False), "stars")
        sweep(spark, since, e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
