"""Recall, precision and pooled labelling."""

from __future__ import annotations

import csv
import io
import json
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..sources.publish import put

K, RECALL_GATE, PRECISION_GATE, SEED = 10, 0.95, 0.8, 311
BLOCK = 4096


def meet(queries: DataFrame, others: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row of ``others`` with each query. Queries are counted and dealt by a hash of their id into blocks of about ``block`` rows, so that no broadcast grows with them."""
    n = max(1, -(-queries.count() // block))
    if n == 1:
        return others.join(F.broadcast(queries))
    place = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return reduce(DataFrame.unionByName, [others.join(F.broadcast(queries.where(place == i))) for i in range(n)])


def top_lists(queries: DataFrame, patterns: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, pattern, rank): each query's k nearest patterns. Each pattern row meets all queries, a block of them at a time."""
    pairs = meet(queries.select("query_id", "vector"), patterns.select("pattern", "embedding"), block)
    line = W.partitionBy("query_id").orderBy(F.desc("sim"), "pattern")
    return pairs.withColumn("sim", dot(F.col("embedding"), F.col("vector"))).withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "pattern", "rank")


def quantised(patterns: DataFrame, levels: int = 127) -> DataFrame:
    """``patterns`` with embeddings as an index of signed bytes would serve them: rounded to ``levels`` steps of their largest component."""
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    x = patterns.withColumn("_m", largest)
    return x.withColumn("embedding", F.transform("embedding", lambda v: F.floor(v.cast("double") * levels / F.col("_m") + 0.5).cast("double") * F.col("_m") / levels)).drop("_m")


def recall(exact: DataFrame, served: DataFrame, k: int = K) -> DataFrame:
    """(query_id, recall) of two top lists."""
    common = exact.select("query_id", "pattern").join(served.select("query_id", "pattern"), ["query_id", "pattern"], "left_semi").groupBy("query_id").agg(F.count("*").alias("c"))
    return exact.select("query_id").distinct().join(common, "query_id", "left").select("query_id", F.round(F.coalesce("c", F.lit(0)) / k, 4).alias("recall"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, as strings; the byte order mark that spreadsheets write isn't part of the first name."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return x.toDF(*[c.lstrip("\ufeff").strip() for c in x.columns])


def cached_vectors(texts: DataFrame, model: str) -> DataFrame:
    """(pattern, embedding) of one model; vectors of others lie in another space."""
    return texts.where(F.col("model") == model).select(F.col("embed_text").alias("pattern"), "embedding")


def read_labels(df: DataFrame) -> DataFrame:
    """Judged rows only: label 0 or 1 after trimming."""
    return df.where(F.trim("label").isin("0", "1")).select("query_id", "pattern", F.trim("label").cast("int").alias("label"))


def precision(served: DataFrame, labels: DataFrame, k: int = K) -> DataFrame:
    """(query_id, precision, served, unjudged); unjudged rows count as not relevant, the denominator is always k."""
    x = served.where(F.col("rank") <= k).join(labels, ["query_id", "pattern"], "left")
    return x.groupBy("query_id").agg(F.round(F.sum(F.coalesce("label", F.lit(0))) / k, 4).alias("precision"), F.count("*").alias("served"), F.count_if(F.col("label").isNull()).alias("unjudged"))


def pool(legs: dict[str, DataFrame], universe: DataFrame, queries: DataFrame, extra: int = 5, seed: int = SEED) -> DataFrame:
    """(query_id, pattern, sources, place): the legs' candidates and ``extra`` seeded others per query, each once, in a seeded order."""
    rows = None
    for name, leg in legs.items():
        one = leg.select("query_id", "pattern", F.lit(name).alias("src"))
        rows = one if rows is None else rows.unionByName(one)
    others = meet(queries.select("query_id"), universe.select("pattern")).join(rows.select("query_id", "pattern"), ["query_id", "pattern"], "left_anti")
    draw = lambda salt: F.xxhash64("query_id", "pattern", F.lit(seed + salt))
    line = W.partitionBy("query_id")
    others = others.withColumn("r", F.row_number().over(line.orderBy(draw(0), "pattern"))).where(F.col("r") <= extra).select("query_id", "pattern", F.lit("random").alias("src"))
    x = rows.unionByName(others).groupBy("query_id", "pattern").agg(F.concat_ws("+", F.array_sort(F.collect_set("src"))).alias("sources"))
    return x.withColumn("place", F.row_number().over(line.orderBy(draw(1), "pattern")))


def _csv(names: list[str], rows: list[tuple]) -> str:
    out = io.StringIO(newline="")
    csv.writer(out).writerows([names, *rows])
    return out.getvalue()


def write_sheet(pooled: DataFrame, queries: DataFrame, directory: str) -> tuple[str, str]:
    """The sheet that people label (with a byte order mark) and, apart from it, where each row came from. People read it, so it is small enough to collect."""
    spark = pooled.sparkSession
    rows = pooled.join(queries.select("query_id", "query"), "query_id").orderBy("query_id", "place").collect()
    sheet = _csv(["query_id", "query", "pattern", "label"], [(r.query_id, r["query"], r.pattern, "") for r in rows])
    meta = _csv(["query_id", "pattern", "sources"], [(r.query_id, r.pattern, r.sources) for r in rows])
    return put(spark, f"{directory}/sheet.csv", sheet.encode("utf-8-sig")), put(spark, f"{directory}/sources.csv", meta.encode())


def percentile(sorted_ms: list[float], p: float) -> float:
    return sorted_ms[max(0, int(p * len(sorted_ms)) - 1)]


def write_report(directory: str, found: list[dict], judged: list[dict] | None = None, took_ms: list[float] | None = None, spark: SparkSession | None = None) -> str:
    """A timestamped Markdown and JSON report; lists queries below 1. With ``spark``, on any file system that Hadoop knows."""
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    mean = sum(r["recall"] for r in found) / len(found) if found else 0.0
    lines = [f"# Evaluation {stamp}", "", f"recall@{K}: mean {mean:.4f}, min {min((r['recall'] for r in found), default=0):.2f}, gate {RECALL_GATE}: {'PASS' if mean >= RECALL_GATE else 'MISS'}", ""]
    lines += [f"- {r['query_id']}: {r['recall']:.2f}" for r in found if r["recall"] < 1]
    if judged is None:
        lines += ["", f"precision@{K}: pending, no labels"]
    else:
        p = sum(r["precision"] for r in judged) / len(judged) if judged else 0.0
        lines += ["", f"precision@{K}: mean {p:.4f}, gate {PRECISION_GATE}: {'PASS' if p >= PRECISION_GATE else 'MISS'}"]
        lines += [f"unjudged among the served: {sum(r.get('unjudged', 0) for r in judged)}"]
    if took_ms:
        lines += ["", f"latency: p50 {percentile(sorted(took_ms), 0.5):.0f} ms, p95 {percentile(sorted(took_ms), 0.95):.0f} ms"]
    base = f"{directory.rstrip('/')}/eval_{stamp}"
    parts = {".md": "\n".join(lines) + "\n", ".json": json.dumps({"timestamp": stamp, "k": K, "recall": found, "precision": judged, "took_ms": took_ms}, ensure_ascii=False)}
    if spark is None:
        Path(directory).mkdir(parents=True, exist_ok=True)
    for end, text in parts.items():
        put(spark, base + end, text.encode()) if spark else Path(base + end).write_text(text, encoding="utf-8")
    return f"{base}.md"
