"""Batch jobs for spark-submit: ``python -m quernstone.plans.jobs HOME JOB ...``.

All tables are versioned under HOME: raw, watermark, facets, overrides, texts,
serving, patterns. A job writes a new version, checks its counts and moves the pointer;
one that fails leaves what was published. The version before the current one
stays, for readers that are at it.
"""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import geo_point, pattern_text
from ..operators import facets as FA
from ..operators import ingest as I
from ..operators import patterns as P
from ..operators import retrieval as R
from ..operators import text as T
from ..schema import FACETS, QUERY_PREFIX
from ..session import at_hand, build_session
from ..sources.publish import CountError, publish, read_current
from ..sources.readers import PagedSource, read_export, read_pages, stage_fields
from ..streaming.incremental import latest_by_key
from . import evaluate as E
from .search import FIELDS, Engine, asks

PARTS = ["complaint_type", "descriptor", "additional_details"]
STATE = "id string, last_created_date timestamp_ntz, rows_pulled bigint"
TEXTS = "model string, embed_text string, embedding array<float>, dim int"
OVERRIDES = "embed_text string, failure_mode string, agencies_involved array<string>, rationale string, prompt_version string"
LEG, EXTRA, UNIVERSE = 15, 5, 500


def _put(df: DataFrame, base: str, expected: int | None = None) -> str:
    return publish(df, base, expected, keep=2)


def _table(spark: SparkSession, home: str, name: str, schema=None) -> DataFrame:
    found = read_current(spark, f"{home}/{name}")
    if found is None:
        if schema is None:
            raise FileNotFoundError(f"{home}/{name} hasn't been published")
        return spark.createDataFrame([], schema)
    return found


def _records(spark: SparkSession, home: str) -> DataFrame:
    return _table(spark, home, "raw").withColumn("embed_text", pattern_text(*[F.col(c) for c in PARTS]))


def _merge(spark: SparkSession, home: str, new: DataFrame, check: bool) -> None:
    old = read_current(spark, f"{home}/raw")
    if old is None and check and not new.groupBy("unique_key").count().where("count > 1").isEmpty():
        raise I.DuplicateKeyError("the batch repeats a unique_key")
    _put(new if old is None else I.upsert(old, new, "unique_key", check=check), f"{home}/raw")


def load_export(spark: SparkSession, home: str, path: str) -> None:
    """Upsert a CSV export; a key that it repeats fails the load."""
    _merge(spark, home, I.clean(read_export(spark, path), "bulk"), check=True)


def pull(spark: SparkSession, home: str, origin: str, token: str | None = None, overlap_days: int = 0) -> None:
    """Upsert what is newer than the watermark, from a paged service (http...) or saved pages, and move the watermark.

    The pulled rows are written first, so that the service is read once and the
    watermark counts the very rows that were merged. ``overlap_days`` asks again
    for the days before the watermark, for rows that came late or changed.
    """
    state = _table(spark, home, "watermark", STATE)
    mark = ([r[0] for r in state.where("id = 'pull'").select("last_created_date").collect()] or [I.START])[0] - timedelta(days=overlap_days)
    if origin.startswith("http"):
        spark.dataSource.register(PagedSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default
        reader = spark.read.format("paged_rest").option("url", origin)
        rows = (reader.option("token", token) if token else reader).load()
        staged = stage_fields(rows.where(F.col("created_date") > mark.isoformat()).where(F.col("agency").isin(I.AGENCIES)))
    else:
        staged = read_pages(spark, origin)
    _put(I.since(I.clean(staged, "incremental"), mark), f"{home}/pulled")
    pulled = _table(spark, home, "pulled")
    if not pulled.isEmpty():
        _merge(spark, home, latest_by_key(pulled, "unique_key", ["created_date", "resolution_updated_date"]), check=False)
        _put(I.advance(state, pulled, "pull", I.START), f"{home}/watermark")


def enrich(spark: SparkSession, home: str, classifier: Callable, model: str, version: str, limit: int | None = None, retry_failed: bool = False, workers: int = 4) -> None:
    """Classify the texts without facets, the most frequent first; with retry_failed also those that need review."""
    have = _table(spark, home, "facets", FACETS)
    have = have.where("not needs_review") if retry_failed else have
    # one text may come in several raw spellings; its first by count and text is asked
    todo = P.pending(P.combos(_records(spark, home), PARTS), have, limit=limit)
    todo = todo.groupBy("embed_text").agg(F.max_by(F.struct(*PARTS, "raw_agencies", "record_count"), F.struct("record_count", *PARTS)).alias("x")).select("embed_text", "x.*")
    _put(_overridden(spark, home, P.insert_absent(have, FA.classify(todo, classifier, model, version, workers), ["embed_text"])), f"{home}/facets")


def _overridden(spark: SparkSession, home: str, facets: DataFrame) -> DataFrame:
    given = _table(spark, home, "overrides", OVERRIDES)
    return P.apply_overrides(facets, given, [c for c in given.columns if c != "embed_text"])


def override(spark: SparkSession, home: str, path: str) -> None:
    """Keep the corrections of a JSON-lines file and apply them to the facets; ``enrich`` applies them again, so that a rebuild doesn't lose them.

    All four columns are set for the exact text. The latest file wins over
    earlier ones; a text that it repeats fails the job.
    """
    new = spark.read.schema(OVERRIDES).json(path)
    if not new.groupBy("embed_text").count().where("count > 1").isEmpty():
        raise I.DuplicateKeyError("the overrides repeat a text")
    _put(P.insert_absent(new, _table(spark, home, "overrides", OVERRIDES), ["embed_text"]), f"{home}/overrides")
    _put(_overridden(spark, home, _table(spark, home, "facets", FACETS)), f"{home}/facets")


def encode(spark: SparkSession, home: str, encoder: Callable, model: str, batch: int = 512) -> None:
    """Encode each distinct text that lacks a vector of the model, once; fails unless every record with a text then has one."""
    have = _table(spark, home, "texts", TEXTS)
    records = _records(spark, home)
    _put(P.insert_absent(have, P.encode(P.missing_texts(records, have, model), encoder, model, batch), ["model", "embed_text"]), f"{home}/texts")
    left = P.missing_texts(records, _table(spark, home, "texts"), model).count()
    if left:
        raise CountError(f"{left} texts have no vector")


def build(spark: SparkSession, home: str, model: str, patterns_only: bool = False) -> None:
    """Publish the patterns and, unless patterns_only, the serving records. Nothing is published while a record has no vector."""
    records, facets = _records(spark, home), _table(spark, home, "facets", FACETS)
    cache = _table(spark, home, "texts").where(F.col("model") == model)
    n = records.count()
    if (with_vector := records.join(cache, "embed_text", "left_semi").count()) != n:
        raise CountError(f"{n} records, {with_vector} with a vector")
    names = records.groupBy("embed_text").agg(F.min_by(F.struct("complaint_type", "descriptor"), F.struct("complaint_type", "descriptor")).alias("x"))
    names = names.select(F.col("embed_text").alias("pattern"), F.trim("x.complaint_type").alias("category"), F.trim("x.descriptor").alias("descriptor"))
    _put(P.pattern_rows(records, facets, cache).join(names, "pattern"), f"{home}/patterns", expected=records.select("embed_text").distinct().count())
    if not patterns_only:
        rows = P.serving(records, facets, cache)
        rows = rows.select(
            F.col("unique_key").alias("key"), F.col("created_date").alias("created"), F.col("closed_date").alias("closed"), F.col("embed_text").alias("pattern"), F.col("complaint_type").alias("category"), "descriptor", "additional_details",
            "agency", "borough", F.col("community_board").alias("board"), "incident_zip", "status", F.col("problem_domain").alias("domain"), "failure_mode", F.col("agencies_involved").alias("agencies"), geo_point(F.col("latitude"), F.col("longitude")).alias("location"),
        )
        _put(rows, f"{home}/serving", expected=n)


def _asked(spark: SparkSession, path: str, encode_one: Callable) -> tuple[list, DataFrame]:
    """The questions of a CSV file (query_id, query), which people wrote and which are therefore few, and their vectors."""
    rows = E.read_sheet(spark, path).select("query_id", "query").collect()
    vectors = [(r.query_id, r["query"], encode_one(r["query"], True)) for r in rows]
    return rows, spark.createDataFrame(vectors, "query_id string, query string, vector array<double>")


def _engine(spark: SparkSession, home: str, encode_one: Callable) -> Engine:
    return Engine(spark, _table(spark, home, "serving"), _table(spark, home, "patterns"), encode_one)


def _served(spark: SparkSession, engine: Engine, rows: list) -> tuple[DataFrame, list[float]]:
    """(query_id, pattern, rank) that the service answers with, and the milliseconds of each answer."""
    lists, took = [], []
    for r in rows:
        began = time.perf_counter()
        ranks = engine.search(r["query"], E.K, explain=True)["explain"]["rrf"]["per_hit_leg_ranks"]
        took.append((time.perf_counter() - began) * 1000)
        lists += [(r.query_id, x["pattern"], i) for i, x in enumerate(ranks, 1)]
    return spark.createDataFrame(lists, "query_id string, pattern string, rank int"), took


def pool(spark: SparkSession, home: str, questions: str, out: str, encoder: Callable, prefix: str = QUERY_PREFIX) -> tuple[str, str]:
    """Write the sheet to label: each question's lexical, vector and served candidates and a few seeded others of the most frequent patterns."""
    one = asks(encoder, prefix)
    rows, asked = _asked(spark, questions, one)
    engine = _engine(spark, home, one)
    lexical = [(r.query_id, x.pattern) for r in rows for x in R.ranked(T.bm25(engine.tokens, T.english_tokens(r["query"]), FIELDS), LEG).collect()]
    legs = {"bm25": spark.createDataFrame(lexical, "query_id string, pattern string"), "knn": E.top_lists(asked, engine.patterns, LEG), "hybrid": _served(spark, engine, rows)[0]}
    universe = at_hand(engine.patterns.orderBy(F.desc("record_count"), "pattern").limit(UNIVERSE).select("pattern"), UNIVERSE)
    return E.write_sheet(E.pool(legs, universe, asked, EXTRA), asked, out)


def evaluate(spark: SparkSession, home: str, questions: str, out: str, encoder: Callable, model: str, labels: str | None = None, prefix: str = QUERY_PREFIX) -> str:
    """Write a report: recall of the published patterns against the model's cached vectors and, with labels, precision of what the service answers."""
    one = asks(encoder, prefix)
    rows, asked = _asked(spark, questions, one)
    engine = _engine(spark, home, one)
    exact = E.top_lists(asked, E.cached_vectors(_table(spark, home, "texts"), model))
    found = E.recall(exact, E.top_lists(asked, engine.patterns)).orderBy("query_id").collect()
    served, took = _served(spark, engine, rows)
    judged = None
    if labels:
        judged = [r.asDict() for r in E.precision(served, E.read_labels(E.read_sheet(spark, labels))).orderBy("query_id").collect()]
        judged += [{"query_id": r.query_id, "precision": 0.0, "served": 0, "unjudged": 0} for r in rows if r.query_id not in {j["query_id"] for j in judged}]
    return E.write_report(out, [r.asDict() for r in found], judged, took, spark)


def _named(spec: str) -> Callable:
    """``module:function``."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("home")
    jobs = p.add_subparsers(dest="job", required=True)
    jobs.add_parser("load-export").add_argument("path")
    x = jobs.add_parser("pull")
    x.add_argument("origin")
    x.add_argument("--token")
    x.add_argument("--overlap-days", type=int, default=0)
    x = jobs.add_parser("enrich")
    x.add_argument("classifier", help="module:function")
    x.add_argument("--model", required=True)
    x.add_argument("--version", required=True)
    x.add_argument("--limit", type=int)
    x.add_argument("--retry-failed", action="store_true")
    x.add_argument("--workers", type=int, default=4)
    x = jobs.add_parser("encode")
    x.add_argument("encoder", help="module:function")
    x.add_argument("--model", required=True)
    x.add_argument("--batch-size", type=int, default=512)
    x = jobs.add_parser("build")
    x.add_argument("--model", required=True)
    x.add_argument("--patterns-only", action="store_true")
    jobs.add_parser("override").add_argument("path")
    for name in ("pool", "evaluate"):
        x = jobs.add_parser(name)
        x.add_argument("questions", help="CSV of query_id and query")
        x.add_argument("out")
        x.add_argument("encoder", help="module:function")
        x.add_argument("--prefix", default=QUERY_PREFIX)
        if name == "evaluate":
            x.add_argument("--model", required=True)
            x.add_argument("--labels", help="the labelled sheet")
    a = p.parse_args(argv)
    spark = spark or build_session(app=f"quernstone-{a.job}")
    if a.job == "load-export":
        load_export(spark, a.home, a.path)
    elif a.job == "pull":
        pull(spark, a.home, a.origin, a.token, a.overlap_days)
    elif a.job == "enrich":
        enrich(spark, a.home, _named(a.classifier), a.model, a.version, a.limit, a.retry_failed, a.workers)
    elif a.job == "encode":
        encode(spark, a.home, _named(a.encoder), a.model, a.batch_size)
    elif a.job == "override":
        override(spark, a.home, a.path)
    elif a.job == "pool":
        pool(spark, a.home, a.questions, a.out, _named(a.encoder), a.prefix)
    elif a.job == "evaluate":
        evaluate(spark, a.home, a.questions, a.out, _named(a.encoder), a.model, a.labels, a.prefix)
    else:
        build(spark, a.home, a.model, a.patterns_only)


if __name__ == "__main__":
    main()
