"""The corpus pipeline: five stages, each of which works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's rows as Parquet in the shared folder and rereads them as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm import decontaminate, line_dedup, minhash, mixing, quality
from quernstone.llm.common import mark, materialise, ship, small_enough, sweep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is fitted on all labelled documents of its input.

    Null and empty texts are judged as an empty text, rows that repeat an id
    one by one; without labels of both classes every row stays.
    """
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, or nearly; those that lose their last word go.

    Null, empty and blank texts lose nothing and stay. Equal ids are one
    document: their rows lose the same line numbers, none to one another. Rows
    with a null id stay as they are.
    """
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words a shingle, similarity 0.8): that of the smallest id.

    Texts without a word and rows with a null id are in no group and stay. Of
    rows that repeat id and text the first by the other columns stays; rows of
    one id with different texts are one document, whose rows stay or go
    together.
    """
    ship(spark)
    gone = minhash.components(docs).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    gone = small_enough(materialise(gone, "copies"))  # else the documents are shuffled to them
    left = docs.join(gone, docs["doc_id"].cast("long") == F.col("_id"), "left_anti")
    # rows whose id and text repeat; they are few or none, so only theirs are shuffled
    same = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")]
    twice = docs.where("doc_id is not null").groupBy(*same).count().where("count > 1").select("_id").distinct()
    twice = materialise(twice, "repeated-ids")
    if twice.isEmpty():
        return left
    twice = small_enough(twice)
    found = left["doc_id"].cast("long") == F.col("_id")
    again = left.join(twice, found, "left_semi")
    others = [F.xxhash64(F.to_json(F.struct(c))) for c in docs.columns if c not in ("doc_id", "text")]
    line = Window.partitionBy("doc_id", "text").orderBy(*others)
    again = again.withColumn("_nth", F.row_number().over(line)).where("_nth = 1").drop("_nth")
    return left.join(twice, found, "left_anti").union(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of hit words as long as a window; items shorter than that reject one only where they fill such a run.

    Null and empty texts have no words and stay; rows that repeat an id are
    judged one by one; an empty benchmark rejects nothing.
    """
    bench = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs, bench)
    return found.where(~F.exists("spans", lambda s: s["end"] - s["begin"] >= decontaminate.WINDOW)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    Null texts have no words, null is a source of its own, and rows that repeat
    an id, or have none, are documents of their own.
    """
    ship(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

#: SQL can't express the fitted classifier nor the pseudorandom draws; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        sweep(spark, since, docs)  # what the stage wrote on its way, and its input
    return docs
