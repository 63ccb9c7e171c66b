"""Scalar expressions: the canonical text, safe casts, vectors, calendar months, rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def pattern_text(*cols: Column) -> Column:
    """The canonical text of a record: its non-blank, trimmed parts joined by '. '; '' if none has any."""
    return F.concat_ws(". ", *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def grouped_double(c: Column) -> Column:
    """A number that may have thousands commas."""
    return blank_to_null(F.replace(c, F.lit(","), F.lit(""))).cast("double")


def any_timestamp(c: Column) -> Column:
    """ISO, or month/day/year with a 12-hour clock; an unreadable value raises, as a cast does."""
    c = blank_to_null(c)
    export = F.try_to_timestamp(c, F.lit("MM/dd/yyyy hh:mm:ss a")).cast("timestamp_ntz")
    return F.when(c.rlike(r"^\d{1,2}/"), F.coalesce(export, c.cast("timestamp_ntz"))).otherwise(c.cast("timestamp_ntz"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def month(c: Column) -> Column:
    """First day of the calendar month, as a date."""
    return F.trunc(c.cast("date"), "month")


def geo_point(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), or null unless both are known."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(ArrayType(FloatType()))
def float_vector(packed: pd.Series) -> pd.Series:
    """Binaries of little-endian 32-bit floats as arrays; no built-in function reads them."""
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


# Words that don't count in the lexical guarantee of pattern selection.
STOP_TOKENS = ["the", "a", "an", "in", "for", "of", "with", "and", "or", "not", "is", "are", "problems", "problem", "complaint", "complaints"]


def significant_tokens(c: Column) -> Column:
    """Lower-case words of more than two characters that aren't stop tokens; punctuation stays."""
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(STOP_TOKENS))


def holds_all(text: Column, tokens: Column) -> Column:
    """Whether the lower-cased text contains every token, of at least one."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(F.lower(text), t))


def short_pattern(c: Column) -> Column:
    """The first two parts of a pattern, for display."""
    return F.array_join(F.slice(F.split(c, r"\. "), 1, 2), " / ")
