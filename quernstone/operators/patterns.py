"""The patterns dimension: distinct texts, their counts, pending work, fan-out and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combos(records: DataFrame, parts: list[str], agency: str = "agency", text: str = "embed_text") -> DataFrame:
    """One row per text and its raw parts: record_count and the sorted, distinct agencies as text."""
    agencies = F.array_join(F.array_sort(F.collect_set(agency)), ", ")
    return records.groupBy(text, *parts).agg(F.count("*").alias("record_count"), F.nullif(agencies, F.lit("")).alias("raw_agencies"))


def pending(found: DataFrame, facets: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """Combos without facets, largest first; rows that need review count as none on a retry."""
    done = facets.where("not needs_review") if retry_failed else facets
    out = found.join(done.select("embed_text"), "embed_text", "left_anti").orderBy(F.desc("record_count"), "embed_text")
    return out.limit(limit) if limit else out


def missing_texts(records: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct non-empty texts without a vector of the model."""
    have = cache.where(F.col("model") == model).select("embed_text")
    return records.where("embed_text <> ''").select("embed_text").distinct().join(have, "embed_text", "left_anti")


def encode(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], model: str, batch: int = 512) -> DataFrame:
    """text cache rows of distinct texts; the encoder is called on batches, once per text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame["embed_text"].iloc[lo : lo + batch].tolist()
                vectors = encoder(part)
                yield pd.DataFrame({"model": model, "embed_text": part, "embedding": vectors, "dim": [len(v) for v in vectors]})

    return texts.select("embed_text").mapInPandas(run, "model string, embed_text string, embedding array<float>, dim int")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def fan_out(records: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """Records with the vector of their text; a join at read time, never a stored copy per record."""
    side = cache.where(F.col("model") == model) if model is not None else cache
    return records.join(side.select("embed_text", "embedding"), "embed_text")


def record_facets(records: DataFrame, facets: DataFrame) -> DataFrame:
    return records.join(facets, "embed_text")


def apply_overrides(facets: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Facets with the override's columns where there is one for the exact text; repeating it changes nothing."""
    o = overrides.select("embed_text", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_given"))
    out = facets.join(o, "embed_text", "left")
    return out.select(*[F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in facets.columns])


def serving(records: DataFrame, facets: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """The denormalised serving rows: records with a vector, and their facets if any."""
    return fan_out(records, cache, model).join(facets.select("embed_text", "problem_domain", "failure_mode", "agencies_involved"), "embed_text", "left")


def pattern_rows(records: DataFrame, facets: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per pattern that has a vector and a record: domain, agencies ([] if unknown), record_count, embedding."""
    counts = records.groupBy("embed_text").agg(F.count("*").alias("record_count"))
    out = cache.select("embed_text", "embedding").join(facets.select("embed_text", "problem_domain", "agencies_involved"), "embed_text", "left").join(counts, "embed_text")
    return out.select(F.col("embed_text").alias("pattern"), F.col("problem_domain").alias("domain"), F.coalesce("agencies_involved", F.array().cast("array<string>")).alias("agencies"), "record_count", "embedding")
