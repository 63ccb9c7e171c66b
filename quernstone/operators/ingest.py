"""Cleaning, upserts and the watermark."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_timestamp, blank_to_null, grouped_double
from ..schema import AGENCIES, GROUPED_DOUBLES, PLAIN_DOUBLES, STAGING_COLUMNS, TIMESTAMPS

START = datetime(2025, 1, 1)


def clean(staging: DataFrame, source: str = "unknown") -> DataFrame:
    """Typed records of staging rows. Blank text is null, rows without a key go, an unreadable value raises."""
    out = []
    for c in STAGING_COLUMNS:
        x = F.col(c)
        if c == "unique_key":
            out.append(blank_to_null(x).cast("bigint").alias(c))
        elif c in TIMESTAMPS:
            out.append(any_timestamp(x).alias(c))
        elif c in GROUPED_DOUBLES:
            out.append(grouped_double(x).alias(c))
        elif c in PLAIN_DOUBLES:
            out.append(blank_to_null(x).cast("double").alias(c))
        elif c != "location_raw":
            out.append(blank_to_null(x).alias(c))
    return staging.where(blank_to_null(F.col("unique_key")).isNotNull()).select(*out, F.lit(source).alias("source"), F.current_timestamp().alias("ingested_at"))


class DuplicateKeyError(ValueError):
    """A batch holds a key twice."""


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("source", "ingested_at"), check: bool = True) -> DataFrame:
    """``old`` with rows of ``new`` replaced or added; columns in ``keep`` retain the values of the first insert.

    One full outer join on the key, so old and new are each shuffled once. A
    key that repeats within ``new`` raises before anything is planned (check).
    """
    if check and not new.groupBy(key).count().where("count > 1").isEmpty():
        raise DuplicateKeyError(f"the batch repeats a {key}")
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    added, there = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    pick = lambda c: F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keep else F.when(added, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def since(records: DataFrame, mark, time_col: str = "created_date", agencies: list[str] | None = None, agency_col: str = "agency") -> DataFrame:
    """Rows after the mark (strictly), of the given agencies; both reach the scan."""
    out = records.where(F.col(time_col) > F.lit(mark))
    return out.where(F.col(agency_col).isin(agencies if agencies is not None else AGENCIES))


def advance(state: DataFrame, pulled: DataFrame, name: str, start, time_col: str = "created_date") -> DataFrame:
    """The watermark after a pull: never goes back, rows add up. A pull of nothing leaves it."""
    seen = pulled.agg(F.max(time_col).alias("latest"), F.count("*").alias("n")).withColumn("id", F.lit(name))
    old = state.where(F.col("id") == name)
    out = seen.join(old, "id", "left").where("n > 0")
    new = out.select("id", F.greatest("latest", F.coalesce("last_created_date", F.lit(start))).alias("last_created_date"), (F.coalesce("rows_pulled", F.lit(0)) + F.col("n")).cast("bigint").alias("rows_pulled"))
    return state.select(*new.columns).join(new.select("id"), "id", "left_anti").unionByName(new)
