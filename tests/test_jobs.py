"""The batch jobs, from an export to an answered question."""

import csv
import json
import sys
import types
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.parse import parse_qs, urlparse

import pytest

from quernstone.operators.ingest import DuplicateKeyError
from quernstone.plans import jobs
from quernstone.plans.search import Engine
from quernstone.schema import STAGING_COLUMNS
from quernstone.sources.publish import CountError, read_current
from quernstone.sources.readers import PagedSource


def line(**row):
    return ",".join(str(row.get(c, "")) for c in STAGING_COLUMNS)


def export(path, rows):
    path.write_text("\n".join([",".join(STAGING_COLUMNS), *rows]) + "\n")
    return str(path)


def plain(texts):
    return [[1.0, 0.0] if "Basin" in t else [0.0, 1.0] for t in texts]


def sorter(combo, wrong):
    if combo["descriptor"] == "Odd":
        raise RuntimeError("refused")
    return {"problem_domain": "drainage", "failure_mode": "blockage", "agencies_involved": ["DEP", "DOT"], "rationale": "r"}


def test_jobs_end_to_end(spark, tmp_path, monkeypatch):
    home = f"file://{tmp_path}/home"
    run = lambda *argv: jobs.main([home, *argv], spark)
    helper = types.ModuleType("job_helpers")
    helper.plain, helper.sorter = plain, sorter
    monkeypatch.setitem(sys.modules, "job_helpers", helper)
    first = [line(unique_key=i, created_date="2025-02-01", complaint_type="Sewer", descriptor="Basin Clogged", agency="DEP", community_board=f"b{i % 2}", borough="BROOKLYN", latitude="40.5", longitude="-73.9") for i in range(6)]
    with pytest.raises(DuplicateKeyError):
        run("load-export", export(tmp_path / "twice.csv", first + first[:1]))
    run("load-export", export(tmp_path / "one.csv", first))

    pages = tmp_path / "pages.json"
    pages.write_text("\n".join(json.dumps(r) for r in [{"unique_key": "1", "created_date": "2025-03-01T00:00:00", "complaint_type": "Sewer", "descriptor": "Basin Clogged", "agency": "DEP", "status": "Closed"}, {"unique_key": "9", "created_date": "2025-03-02T00:00:00", "complaint_type": "Noise", "descriptor": "Odd", "agency": "DOT"}, {"unique_key": "10", "created_date": "2025-03-02T00:00:00", "agency": "ELSEWHERE"}, {"unique_key": "11", "created_date": "2024-03-02T00:00:00", "agency": "DEP"}]))
    for _ in range(2):  # the second pull finds nothing newer
        run("pull", str(pages))
    raw = {r.unique_key: r for r in read_current(spark, f"{home}/raw").collect()}
    assert set(raw) == {0, 1, 2, 3, 4, 5, 9} and (raw[1].status, raw[1].source, raw[9].source) == ("Closed", "bulk", "incremental")
    mark = read_current(spark, f"{home}/watermark").collect()
    assert [(r.last_created_date, r.rows_pulled) for r in mark] == [(datetime(2025, 3, 2), 2)]

    with pytest.raises(FileNotFoundError):
        run("build", "--model", "m")
    run("encode", "job_helpers:plain", "--model", "m")
    for extra in ([], ["--retry-failed"]):
        run("enrich", "job_helpers:sorter", "--model", "m", "--version", "v1", *extra)
    assert {(r.embed_text, r.needs_review) for r in read_current(spark, f"{home}/facets").collect()} == {("Sewer. Basin Clogged", False), ("Noise. Odd", True)}
    run("build", "--model", "m")
    serving, patterns = (read_current(spark, f"{home}/{t}") for t in ("serving", "patterns"))
    assert serving.count() == 7 and {(r.pattern, r.record_count, tuple(r.agencies)) for r in patterns.collect()} == {("Sewer. Basin Clogged", 6, ("DEP", "DOT")), ("Noise. Odd", 1, ())}
    assert serving.where("key = 0").first().location.lat == 40.5
    answer = Engine(spark, serving, patterns, lambda text, query: [1.0, 0.0]).search("Top 10 districts for basin clogging citywide?", today=date(2026, 7, 1))
    assert answer["aggregation"]["total"] == 6 and answer["results"]

    fixes = tmp_path / "fixes.json"
    fixes.write_text(json.dumps({"embed_text": "Sewer. Basin Clogged", "failure_mode": "structural_damage", "agencies_involved": ["DEP"], "rationale": "by hand", "prompt_version": "v1.1"}))
    run("override", str(fixes))
    run("enrich", "job_helpers:sorter", "--model", "m", "--version", "v2")  # a later run keeps them
    fixed = {r.embed_text: (r.failure_mode, r.agencies_involved, r.prompt_version) for r in read_current(spark, f"{home}/facets").collect()}
    assert fixed["Sewer. Basin Clogged"] == ("structural_damage", ["DEP"], "v1.1") and fixed["Noise. Odd"][0] is None
    fixes.write_text(fixes.read_text() + "\n" + fixes.read_text())
    with pytest.raises(DuplicateKeyError):
        run("override", str(fixes))

    (tmp_path / "asked.csv").write_text("query_id,query\nq1,basin clogging\nq2,\"odd, loud noise\"\n")
    run("pool", str(tmp_path / "asked.csv"), f"file://{tmp_path}/labels", "job_helpers:plain")
    sheet = (tmp_path / "labels" / "sheet.csv").read_bytes()
    assert sheet.startswith(b"\xef\xbb\xbfquery_id,query,pattern,label") and sheet.count(b'"odd, loud noise"') == 2
    sources = {tuple(row) for row in csv.reader(open(tmp_path / "labels" / "sources.csv"))}
    assert {("q1", "Sewer. Basin Clogged"), ("q1", "Noise. Odd"), ("q2", "Sewer. Basin Clogged"), ("q2", "Noise. Odd")} == {s[:2] for s in sources} - {("query_id", "pattern")}
    assert ("q1", "Sewer. Basin Clogged", "bm25+hybrid+knn") in sources
    golden = tmp_path / "golden.csv"
    golden.write_bytes(sheet.replace(b"Sewer. Basin Clogged,", b"Sewer. Basin Clogged, 1 "))
    run("evaluate", str(tmp_path / "asked.csv"), f"file://{tmp_path}/report", "job_helpers:plain", "--model", "m", "--labels", str(golden))
    (report,) = (tmp_path / "report").glob("eval_*.json")
    found = json.loads(report.read_text())
    assert [r["recall"] for r in found["recall"]] == [0.2, 0.2]  # both patterns there are, of the ten asked for
    assert [(r["query_id"], r["precision"], r["unjudged"]) for r in found["precision"]] == [("q1", 0.1, 1), ("q2", 0.1, 1)] and len(found["took_ms"]) == 2

    run("load-export", export(tmp_path / "two.csv", [line(unique_key=20, created_date="2025-04-01", complaint_type="New")]))
    with pytest.raises(CountError):  # its text has no vector yet: what was published stays
        run("build", "--model", "m")
    assert read_current(spark, f"{home}/serving").count() == 7


class Service(BaseHTTPRequestHandler):
    """Pages of records by $limit and $offset; notes what was asked."""

    asked: list[dict] = []
    rows = [{"unique_key": str(i), "created_date": f"2025-03-0{1 + i}T00:00:00", "agency": "DEP", "open_data_channel_type": "PHONE"} for i in range(5)]

    def do_GET(self):
        query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        self.asked.append(query)
        at = int(query["$offset"])
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(self.rows[at : at + int(query["$limit"])]).encode())

    def log_message(self, *args):
        pass


def test_paged_service(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    home, url = f"file://{tmp_path}/home", f"http://127.0.0.1:{server.server_port}/r.json"
    try:
        jobs.pull(spark, home, url)
        assert all("created_date > '2025-01-01" in q["$where"] and "agency IN (" in q["$where"] and q["$order"] == "created_date ASC" for q in Service.asked)
        got = read_current(spark, f"{home}/raw").collect()
        assert {r.unique_key for r in got} == {0, 1, 2, 3, 4} and {r.channel_type for r in got} == {"PHONE"}
        spark.dataSource.register(PagedSource)
        for pages in ("1", "3"):
            rows = spark.read.format("paged_rest").option("url", url).option("page", "2").option("pages", pages).load()
            assert sorted(r.unique_key for r in rows.collect()) == list("01234")
    finally:
        server.shutdown()
