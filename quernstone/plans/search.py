"""The question service: parse, select, retrieve, aggregate, drill down, explain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregations as A
from ..operators import retrieval as R
from ..operators import text as T
from ..schema import QUERY_PREFIX
from .parser import Expand, ParsedQuery, parse

RECORD_FIELDS = ["key", "created", "category", "descriptor", "borough", "board", "agency", "status", "domain", "agencies"]


FIELDS = {"full_text": 2.0, "category": 1.0, "descriptor": 1.0}


def asks(encoder: Callable[[list[str]], list[list[float]]], prefix: str = QUERY_PREFIX) -> Callable[[str, bool], list[float]]:
    """A batch encoder as the service calls it: one text, with the prefix in front of a question."""
    return lambda text, is_query: [float(x) for x in encoder([prefix + text if is_query else text])[0]]


def vector_column(v: list[float]):
    return F.array(*[F.lit(float(x)) for x in v])


class Engine:
    """Holds the records and the patterns dimension; every answer is planned afresh over them."""

    def __init__(self, spark: SparkSession, records: DataFrame, patterns: DataFrame, encoder: Callable[[str, bool], list[float]], floor: float = R.FLOOR):
        self.spark, self.records, self.encoder, self.floor = spark, records, encoder, floor
        self.patterns = patterns.cache()
        self.tokens = T.analyse(patterns.select("pattern", "record_count", F.col("pattern").alias("full_text"), "category", "descriptor"), ["full_text", "category", "descriptor"]).cache()

    def hybrid(self, topic: str, vector: list[float], scoped: DataFrame, size: int = 10) -> DataFrame:
        """Representatives of the fused and reranked patterns. Filters apply to the lexical leg and to the records, not to the vector leg."""
        present = scoped.select("pattern").distinct()
        scores = T.bm25(self.tokens, T.english_tokens(topic), FIELDS)
        lexical = R.ranked(scores.join(present, "pattern", "left_semi"), R.LEXICAL_DEPTH)
        near = R.nearest(self.patterns, vector_column(vector), R.VECTOR_DEPTH)
        fused = R.consensus(R.fuse(lexical, near), self.patterns)
        return R.representatives(fused, scoped.drop("domain"), size)

    def aggregate(self, parsed: ParsedQuery, selected: DataFrame, scoped: DataFrame) -> dict:
        agg, base = parsed.aggregation, A.on_topic(scoped, selected)
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        if agg.expand is not None:
            found = rows(A.drill_down(base, agg.expand.group_value, agg.expand.size, columns=[c for c in RECORD_FIELDS if c in self.records.columns]))
            total = found[0]["total"] if found else base.where(F.col("board") == agg.expand.group_value).count()
            return {"type": "records", "group_value": agg.expand.group_value, "total": total, "records": [{k: v for k, v in r.items() if k != "total"} for r in found]}
        hint = lambda d: {"expand_group": d, "agg_type": agg.type}
        if agg.type == "agency_facets":
            chosen = selected.join(self.patterns.select("pattern", "agencies"), "pattern").orderBy("rank").select("pattern", "agencies")
            shown = rows(chosen)
            return {"type": agg.type, "total": base.count(), "routed_agency": rows(A.routed(base)), "involved_agencies": rows(A.involved(base)), "patterns": shown[:10], "multi_agency_pattern_count": sum(len(p["agencies"]) >= 2 for p in shown)}
        if agg.type == "trend":
            series: dict[str, list] = {}
            for r in rows(A.monthly(base).orderBy("district", "month")):
                series.setdefault(r["district"], []).append({"month": r["month"].strftime("%Y-%m"), "count": r["count"]})
            buckets = [r | {"monthly": series[r["district"]], "expand": hint(r["district"])} for r in rows(A.trend(base))]
            return {"type": agg.type, "group_by": "community_board", "metric": "second_half_vs_first_half_growth", "buckets": buckets}
        if agg.type == "topn":
            return {"type": agg.type, "group_by": "community_board", "n": agg.top_n or 10, "total": base.count(), "buckets": [r | {"expand": hint(r["district"])} for r in rows(A.topn(base, agg.top_n))]}
        if agg.type == "cooccurrence":
            found = A.cells(base).cache()
            n = found.count()
            if not n:
                return {"type": agg.type, "buckets": [], "cells_used": 0}
            return {"type": agg.type, "cells_used": n, "cell_definition": "community_board x calendar month, >=5 topic records", "buckets": rows(A.cooccurrence(self.records, scoped, selected, found)), "domains_in_cells": rows(A.domains_inside(scoped, selected, found).withColumnRenamed("domain", "domain"))}
        buckets: dict[str, dict] = {}
        for r in rows(A.distribution(base).orderBy(F.desc("district_count"), "district", "place")):
            b = buckets.setdefault(r["district"], {"district": r["district"], "count": r["district_count"], "categories": [], "expand": hint(r["district"])})
            if r["category"] is not None:
                b["categories"].append({"category": r["category"], "count": r["category_count"]})
        return {"type": agg.type, "group_by": "community_board", "total": base.count(), "buckets": list(buckets.values())}

    def search(self, q: str, size: int = 10, explain: bool = False, expand_group: str | None = None, expand_size: int = 20, today: date | None = None) -> dict:
        if not q:
            raise ValueError("an empty question")
        parsed = parse(q, today)
        if expand_group and parsed.aggregation:
            parsed = replace(parsed, aggregation=replace(parsed.aggregation, expand=Expand(expand_group, expand_size)))
        vector = self.encoder(parsed.topic, True)
        selected = R.select_patterns(self.patterns, vector_column(vector), F.lit(parsed.topic), floor=self.floor).cache()
        period = parsed.time_range
        scoped = A.filtered(self.records, parsed.geo.borough, period and period.gte, period and period.lte)
        hits = self.hybrid(parsed.topic, vector, scoped, size).withColumn("rrf_score", F.bround("score", 5)).collect()
        chosen = [r.asDict() for r in selected.orderBy("rank").collect()]
        body: dict = {"results": [{k: v for k, v in r.asDict(recursive=True).items() if k in [*RECORD_FIELDS, "rrf_score"]} for r in hits]}
        if parsed.aggregation is not None and chosen:
            body["aggregation"] = self.aggregate(parsed, selected, scoped)
        if explain:
            ranks = [{"pattern": r["pattern"], "bm25_rank": r["rank_0"], "knn_rank": r["rank_1"], "domain": r["domain"]} for r in hits]
            body["explain"] = {"parsed": asdict(parsed), "selected_patterns": [{k: r[k] for k in ("pattern", "sim", "via")} for r in chosen], "rrf": {"rrf_k": R.RRF_K, "leg_depth": R.LEXICAL_DEPTH, "fusion_granularity": "pattern", "consensus_domain": hits[0]["agreed"] if hits else None, "per_hit_leg_ranks": ranks}}
        return body

    def health(self) -> dict:
        return {"ok": True, "patterns_loaded": self.patterns.count()}
