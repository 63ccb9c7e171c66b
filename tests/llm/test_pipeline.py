"""The pipeline's stages, each against brute force on its own input, and the SQL of the operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quernstone.llm import queries
from quernstone.llm.common import materialise

from .test_operators import alnum, brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, docs, SF), "stage")
        if stage is not cp.mixing_stage:
            assert out.columns == names
        seen.append((stage, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}))
        docs = out
    for stage, before, after in seen:
        if stage is cp.quality_stage:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all((d in after) == (labels[d] == 1) for d in before if d in labels)
        elif stage is cp.line_stage:
            want = brute_lines({d: r.text for d, r in before.items()})
            kept = {d: t for d, t in want.items() if t == before[d].text or t.split()}
            assert {d: r.text for d, r in after.items()} == kept and all(r.n_chars == len(r.text) for r in after.values())
        elif stage is cp.near_duplicate_stage:
            want = brute_components({d: r.text for d, r in before.items()}, 5)
            assert set(after) == {d for d, (_, c) in want.items() if c == d}
        elif stage is cp.decontamination_stage:
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = alnum(r.text)
                windows |= {tuple(w[i : i + 8]) for i in range(max(len(w) - 7, min(1, len(w))))}
            sizes = {len(x) for x in windows}
            dirty = {d for d, r in before.items() for w in [alnum(r.text)] for k in sizes for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows}
            assert set(after) == set(before) - dirty
        else:
            assert set(after) == set(before) and all(r.taken <= 2 * r.size for r in after.values())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())


def test_short_item_alone_rejects_nothing(spark, tmp_path):
    item = "one two three four five six seven eight nine"
    spark.createDataFrame([(1, "Yes"), (2, "in the end"), (3, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {1: "yes", 2: "and in the end they said yes", 3: "so one two three four five six seven eight then", 4: "clean", 5: "one two three four five six seven", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in cp.decontamination_stage(spark, docs, str(tmp_path)).collect()} == {1, 2, 4, 5, 6}


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{i % 4000}" for i in range(50_000))
    plain = "a plain first line of words\nand another line that says more than that"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, plain, "en", "a", 70), (4, plain, "en", "a", 70), (4, plain, "fr", "b", 70), (5, plain.upper(), "en", "b", 70), (None, plain, "en", "a", 70), (6, long, "de", "b", len(long)), (7, "x y z " * 20, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("n_lines", "n_removed", "score", "x", "spans", "items", "n_words", "id", "component", "key", "row", "size", "_less", "doc"):
        docs = docs.withColumn(clash, F.lit("clash"))
    docs = materialise(docs, "odd")
    got = {}
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        got[stage] = sorted(((r.doc_id or -1) for r in out.collect()))
        assert stage is cp.mixing_stage or out.columns == docs.columns
    every = [-1, 1, 2, 3, 4, 4, 4, 5, 6, 7]
    assert {1, 2, 3} <= set(got[cp.line_stage]) and got[cp.line_stage].count(4) == 3 and 5 not in got[cp.line_stage]
    assert got[cp.near_duplicate_stage] == [-1, 1, 2, 3, 4, 6, 7]
    assert got[cp.decontamination_stage] == got[cp.mixing_stage] == every
    assert set(got[cp.quality_stage]) <= set(every)


def test_run(spark):
    assert cp.run(spark, SF).agg(F.sum("taken")).first()[0] > 0
