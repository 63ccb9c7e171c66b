"""Mixing sources to target weights, as a plan of fixed-length blocks.

The documents of a source, in a pseudorandom order, are packed end to end into
blocks of ``block`` words (the last may be shorter). Every output shard draws a
multinomial number of blocks from each source; the draws of a source, counted
through the shards, become slots, and a slot maps to a block by a pseudorandom
permutation of the source's blocks (the swap-or-not shuffle of Hoang, Morris
and Rogaway, 2012), pass after pass. Draws beyond a source's quota go to the
sources that fell short, and the last draw is cut to the word, so every source
meets its target. Blocks and slots are joined by (source, block index).

All of it is DataFrame operations; nothing depends on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Params:
    share: float = 1.5  # of all words that the mix holds
    most: int = 2  # passes over a source at most
    weights: tuple[int, ...] = (3, 1, 2)  # of sources by code point, null last, repeating
    block: int = 2048  # words
    shard: int = 1024  # blocks of an output shard
    rounds: int = 48  # of the permutation
    bucket: int = 1_000  # rows that a prefix sum takes in one window, about
    seed: int = 20240229


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, p: Params) -> DataFrame:
    """sizes (source, source_size) with rank and target: shares by weight, none above ``most`` times its size.

    Filling up by weight stops at a level l with target = min(most * size,
    l * weight); the sources that stop at their size are those of the smallest
    size per weight, so running sums over that order give the level. One row a
    source goes through these windows.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), (F.pmod(F.col("rank"), F.lit(len(p.weights))) + 1).cast("int"))
    x = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(p.most))
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    x = x.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if this and all later sources share what the earlier ones leave
    x = x.withColumn("level", (F.sum("source_size").over(whole) * p.share - F.col("capped")) / F.col("free"))
    # from the first source that the level doesn't fill, the level holds
    x = x.withColumn("held", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("held") * F.col("weight")))
    return x.select("source", "source_size", "rank", "weight", target.alias("target"))


def prefix_sums(df: DataFrame, key: str, order: list[str], value: str, out: str, bucket_of: Column) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its key, in two levels, so that no window holds a whole key.

    Rows are ordered by (bucket_of, order).
    """
    x = df.withColumn("_bucket", bucket_of)
    sums = x.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    above = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    within = W.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    x = x.join(sums, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return x.withColumn(out, F.col("_above") + F.col("_within")).drop("_bucket", "_key", "_b", "_above", "_within")


def shuffled(index: Column, n: Column, salt: Column, p: Params) -> Column:
    """Swap-or-not: a permutation of 0 .. n - 1 for each salt, computed for one index."""
    h = lambda *c: F.xxhash64(*c, F.lit(p.seed))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(h(r, salt), n) - x, n)
        return F.when(h(r, salt, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(p.rounds)), index.cast("long"), step)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, slots, uses), all in the shared folder.

    rows: row, id, source, rank, size, source_size, target and the document's
    first word in its source. slots: shard, rank, draw, block, words taken from
    the block's start. uses: row, shard, draw, begin and end of the words of a
    document that a slot takes.

    Null texts have no words; null is a source of its own; null and repeated
    ids are rows like others. An empty table, or one without words, mixes nothing.
    """
    p = params
    # a key of the content orders rows alike on every run; rows that agree in it are copies, or alike in what matters here
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(p.seed)).alias("key"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = materialise(targets(sizes, p).join(sizes.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    rows = rows.join(aims.select(F.col("source").alias("s"), "rank", "source_size", "target", "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # buckets by hash: as many as keep a window near p.bucket rows, whatever the source's size
    buckets = F.ceil(F.col("docs") / p.bucket).cast("long")
    rows = materialise(prefix_sums(rows, "rank", ["key", "id", "row"], "size", "first", F.pmod(F.xxhash64("key"), buckets)).drop("docs", "key"), "mix-rows")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    full = F.floor(F.col("source_size") / p.block).cast("long")
    tail = F.col("source_size") - F.col("full") * p.block
    q = aims.where("source_size > 0").withColumn("quota", quota).withColumn("full", full).withColumn("tail", tail)
    q = q.withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long")).withColumn("passes", F.floor(F.col("quota") / F.col("source_size")).cast("long"))
    q = q.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    # the shorter last block comes last in a pass, so every draw before it holds p.block words
    q = q.withColumn("draws", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / p.block).cast("long"))
    q = materialise(q.select("rank", "weight", "quota", "source_size", "full", "tail", "blocks", "passes", "rest", "draws"), "mix-quotas")
    slots = materialise(_slots(q, p), "mix-slots")
    return rows, slots, materialise(_uses(rows, slots, p), "mix-uses")


def _slots(q: DataFrame, p: Params) -> DataFrame:
    # multinomial counts by shard: every place of a shard points at one of all draws, and so at that draw's source
    before = F.coalesce(F.sum("draws").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = q.where("draws > 0").select("rank", before.alias("from"), (before + F.col("draws")).alias("to"))
    total = share.agg(F.max("to").alias("total")).first()["total"] or 0
    if not total:
        return _stretch(share, "from", "to", p).select(F.lit(-1).cast("long").alias("shard"), "rank", F.col("at").alias("draw"), F.col("at").alias("block"), F.col("at").alias("words"))
    every = _stretch(share, "from", "to", p).select(F.col("at").alias("pick"), "rank")
    places = q.sparkSession.range(total).select(F.floor(F.col("id") / p.shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(total)).alias("pick"))
    drawn = places.join(every, "pick").select("shard", "rank")
    counts = drawn.groupBy("shard", "rank").count()
    counts = prefix_sums(counts, "rank", ["shard"], "count", "from", F.floor(F.col("shard") / 4096))
    counts = materialise(counts, "mix-counts")
    # over-drawn sources give up what exceeds their draws; the others get as many more, in a shard of their own
    got = counts.groupBy("rank").agg(F.sum("count").alias("got"))
    kept = counts.join(q, "rank").where("from < draws").select("shard", "rank", "from", F.least(F.col("from") + F.col("count"), F.col("draws")).alias("to"))
    more = q.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < draws").select(F.lit(-1).cast("long").alias("shard"), "rank", F.col("got").alias("from"), F.col("draws").alias("to"))
    slots = _stretch(kept.union(more), "from", "to", p).select("shard", "rank", F.col("at").alias("draw")).join(q, "rank")
    run = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    slots = slots.withColumn("run", run).withColumn("at", F.col("draw") - F.col("run") * F.col("blocks"))
    block = F.when(F.col("at") < F.col("full"), shuffled(F.col("at"), F.greatest("full", F.lit(1)), F.xxhash64("rank", "run"), p)).otherwise(F.col("at"))
    long = F.when(F.col("at") < F.col("full"), F.lit(p.block).cast("long")).otherwise(F.col("tail"))
    words = F.when(F.col("run") < F.col("passes"), long).otherwise(F.least(long, F.col("rest") - F.col("at") * p.block))
    return slots.select("shard", "rank", "draw", block.alias("block"), words.alias("words"))


def _stretch(df: DataFrame, low: str, high: str, p: Params) -> DataFrame:
    """``df`` with a row for each number ``at`` from ``low`` to before ``high``; a long range is dealt out in pieces first."""
    last = F.floor((F.col(high) - F.col(low) - 1) / p.shard)
    pieces = df.where(F.col(low) < F.col(high)).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("_low", F.col(low) + F.col("_k") * p.shard).repartition("rank", "_low")
    return pieces.withColumn("at", F.explode(F.sequence(F.col("_low"), F.least(F.col("_low") + p.shard, F.col(high)) - 1))).drop("_k", "_low")


def _uses(rows: DataFrame, slots: DataFrame, p: Params) -> DataFrame:
    last = F.floor((F.col("first") + F.col("size") - 1) / p.block).cast("long")
    spans = rows.where("size > 0").select("row", "rank", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / p.block).cast("long"), last)).alias("block"))
    both = spans.join(slots, ["rank", "block"])
    begin = F.greatest(F.col("first"), F.col("block") * p.block)
    end = F.least(F.col("first") + F.col("size"), F.col("block") * p.block + F.col("words"))
    return both.withColumn("begin", begin - F.col("first")).withColumn("end", end - F.col("first")).where("begin < end").select("row", "shard", "draw", "begin", "end")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    rows, _, uses = plan(docs, id_col, text_col, source_col, params)
    taken = uses.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
