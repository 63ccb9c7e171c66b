"""The five question shapes over selected records, and the drill-down.

``records`` have pattern, board, borough, created (timestamp_ntz), category,
domain, agency and agencies. ``base`` is what the topic, borough and time
filters leave; ``selected`` is the small dimension of chosen patterns. Shapes
that need several totals take a ``cube`` instead, which one scan of the records
makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month


def filtered(records: DataFrame, borough: str | None = None, gte: str | None = None, lte: str | None = None) -> DataFrame:
    out = records
    if borough:
        out = out.where(F.col("borough") == borough)
    if gte:
        out = out.where(F.col("created") >= F.lit(gte).cast("timestamp_ntz"))
    if lte:
        out = out.where(F.col("created") <= F.lit(lte).cast("timestamp_ntz"))
    return out


def cube(records: DataFrame) -> DataFrame:
    """(pattern, domain, board, month, n): records counted once; cells, co-occurrence and baselines follow from it."""
    return records.groupBy("pattern", "domain", "board", month(F.col("created")).alias("month")).agg(F.count("*").alias("n"))


def _size(df: DataFrame):
    """The number of records behind rows of records or of a cube."""
    return F.sum("n") if "n" in df.columns else F.count("*")


def _month(df: DataFrame):
    return F.col("month") if "month" in df.columns else month(F.col("created"))


def on_topic(records: DataFrame, selected: DataFrame) -> DataFrame:
    """Records of the selected patterns. The planner broadcasts them if their size is below its threshold, else it shuffles."""
    return records.join(selected.select("pattern"), "pattern", "left_semi")


def off_topic(records: DataFrame, selected: DataFrame) -> DataFrame:
    """All others, those without a pattern included."""
    return records.join(selected.select("pattern"), "pattern", "left_anti")


def top_groups(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """(key, count) of the largest groups, ties by key; null is no group."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(_size(df).alias("count")).orderBy(F.desc("count"), key)
    return out.limit(n) if n else out


def distribution(base: DataFrame, boards: int = 30, categories: int = 8) -> DataFrame:
    """district, district_count, category, category_count, place: the largest districts with their largest categories.

    One pass over the records; a district's list is as long as there are categories.
    """
    cells = base.where("board is not null").groupBy("board", "category").agg(F.count("*").alias("c"))
    known = F.when(F.col("category").isNotNull(), F.struct((-F.col("c")).alias("less"), "category"))
    per = cells.groupBy("board").agg(F.sum("c").alias("district_count"), F.sort_array(F.collect_list(known)).alias("lists"))
    top = per.orderBy(F.desc("district_count"), "board").limit(boards)
    each = top.select(F.col("board").alias("district"), "district_count", F.posexplode_outer(F.slice("lists", 1, categories)).alias("at", "one"))
    return each.select("district", "district_count", "one.category", (-F.col("one.less")).alias("category_count"), (F.col("at") + 1).alias("place"))


def routed(base: DataFrame, n: int = 7) -> DataFrame:
    return top_groups(base, "agency", n)


def routed_by(records: DataFrame, key: str = "pattern", n: int = 3) -> DataFrame:
    """(key, agency, count, place, total): the agencies that most of each key's records go to; total counts those without an agency too."""
    line = W.partitionBy(key)
    x = records.groupBy(key, "agency").agg(F.count("*").alias("count")).withColumn("total", F.sum("count").over(line))
    x = x.withColumn("place", F.row_number().over(line.orderBy(F.col("agency").isNull(), F.desc("count"), "agency")))
    return x.where((F.col("place") <= n) & F.col("agency").isNotNull()).select(key, "agency", "count", "place", "total")


def involved(base: DataFrame, n: int = 7) -> DataFrame:
    """A record counts once for each agency of its set. Counted per set first, then spread."""
    sets = base.where("agencies is not null").groupBy("agencies").agg(F.count("*").alias("c"))
    each = sets.select(F.explode(F.array_distinct("agencies")).alias("agency"), "c")
    return each.where("agency is not null").groupBy("agency").agg(F.sum("c").alias("count")).orderBy(F.desc("count"), "agency").limit(n)


def monthly(base: DataFrame, boards: int = 60, least: int = 30) -> DataFrame:
    """district, month, count: the months between a district's first and last, empty ones as 0, for the largest districts of at least ``least`` records.

    One pass over the records; a district's map is as long as it has months.
    """
    cells = base.where("board is not null").groupBy("board", month(F.col("created")).alias("month")).agg(F.count("*").alias("c"))
    entry = F.when(F.col("month").isNotNull(), F.struct("month", "c"))
    per = cells.groupBy("board").agg(F.sum("c").alias("total"), F.min("month").alias("a"), F.max("month").alias("b"), F.map_from_entries(F.collect_list(entry)).alias("by_month"))
    top = per.where(F.col("total") >= least).orderBy(F.desc("total"), "board").limit(boards)
    line = top.select(F.col("board").alias("district"), "total", "by_month", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return line.select("district", "total", "month", F.coalesce(F.try_element_at("by_month", "month"), F.lit(0)).alias("count"))


def trend(base: DataFrame, top: int = 15, boards: int = 60, least: int = 30, months: int = 4) -> DataFrame:
    """Growth from the first half of a district's months to the second, which has the odd one. Ties keep the larger count first."""
    series = W.partitionBy("district")
    x = monthly(base, boards, least).withColumn("i", F.row_number().over(series.orderBy("month"))).withColumn("n", F.count("*").over(series)).where(F.col("n") >= months)
    first = F.col("i") <= F.floor(F.col("n") / 2)
    x = x.groupBy("district").agg(F.max("total").alias("count"), F.sum(F.when(first, F.col("count")).otherwise(0)).alias("first_half"), F.sum(F.when(~first, F.col("count")).otherwise(0)).alias("second_half"))
    x = x.withColumn("growth", F.round((F.col("second_half") - F.col("first_half")) / F.greatest("first_half", F.lit(1)), 3))
    return x.orderBy(F.desc("growth"), F.desc("count"), "district").limit(top)


def topn(base: DataFrame, n: int | None = None) -> DataFrame:
    """rank, district, count of the n (10 for none or 0) largest districts."""
    found = top_groups(base, "board", n or 10)
    return found.select(F.row_number().over(W.orderBy(F.desc("count"), "board")).alias("rank"), F.col("board").alias("district"), "count")


def cells(base: DataFrame, least: int = 5, limit: int = 100, mode: str = "first") -> DataFrame:
    """(board, month, count) cells of at least ``least`` records among the first ``limit`` by key, or (mode="largest") the largest. ``base``: records or their cube."""
    out = base.withColumn("month", _month(base)).where("board is not null and month is not null").groupBy("board", "month").agg(_size(base).alias("count"))
    order = ["board", "month"] if mode == "first" else [F.desc("count"), "board", "month"]
    return out.orderBy(*order).limit(limit).where(F.col("count") >= least)


def inside(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records in the cells, of which there are at most a hundred."""
    return records.withColumn("month", _month(records)).join(F.broadcast(found.select("board", "month")), ["board", "month"], "left_semi")


def cooccurrence(records: DataFrame, scoped: DataFrame, selected: DataFrame, found: DataFrame, patterns: int = 15, baseline: int = 300) -> DataFrame:
    """pattern, count, share_in_cells, lift_vs_citywide: what else happens in the topic's cells, by lift.

    records, scoped: all records and those under the borough and time filters,
    or their cubes; the baseline is over all. The patterns are the most frequent in the cells; one that is
    not among the baseline's has no lift and comes last.
    """
    here = inside(off_topic(scoped, selected), found).groupBy("pattern").agg(_size(scoped).alias("count"))
    total = here.agg(F.sum("count").alias("t"))
    city = off_topic(records, selected).groupBy("pattern").agg(_size(records).alias("city"))
    city_total = city.agg(F.sum("city").alias("ct"))
    top = here.where("pattern is not null").orderBy(F.desc("count"), "pattern").limit(patterns).join(F.broadcast(total))
    base = city.where("pattern is not null").orderBy(F.desc("city"), "pattern").limit(baseline).join(F.broadcast(city_total))
    x = top.join(base, "pattern", "left").withColumn("share", F.col("count") / F.greatest("t", F.lit(1)))
    x = x.withColumn("lift_vs_citywide", F.round(F.col("share") / (F.col("city") / F.col("ct")), 2))
    return x.orderBy(F.coalesce("lift_vs_citywide", F.lit(0.0)).desc(), F.desc("count"), "pattern").select("pattern", "count", F.round("share", 4).alias("share_in_cells"), "lift_vs_citywide")


def domains_inside(scoped: DataFrame, selected: DataFrame, found: DataFrame, n: int = 6) -> DataFrame:
    return top_groups(inside(off_topic(scoped, selected), found), "domain", n)


def drill_down(base: DataFrame, board: str, size: int = 20, extra=None, columns: list[str] | None = None, tie: tuple[str, ...] = ("key",)) -> DataFrame:
    """The latest records behind one bucket, with the exact total in each row. The total reads none but the filters' columns."""
    out = base.where(F.col("board") == board)
    if extra is not None:
        out = out.where(extra)
    total = out.agg(F.count("*").alias("total"))  # one row
    order = [F.col("created").desc_nulls_last(), *tie]
    out = out.orderBy(*order).limit(size).join(F.broadcast(total)).orderBy(*order)
    return out.select(*(columns or base.columns), "total")
