"""The ten operators against brute force, round trips and held-out labels, and on odd inputs."""

import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import chat_trees, decontaminate, html_extract, langid, line_dedup, minhash, mixing, quality, queries, url_rules, vector_dedup
from quernstone.llm.common import crc_mod, ship
from quernstone.llm.components import connected_components

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, copies, a repeated id, a very long text, clashing column names."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "One two", "en", None, 7), (5, "one TWO", "en", "b", 7), (5, "one TWO", "en", "b", 7), (None, "no id here at all", "fr", "b", 5), (6, long, "de", "b", len(long)), (7, "!!! 123 —", "de", "b", 9)]
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("id", F.lit("x"))


def near_texts(n, seed, size=60):
    rng = random.Random(seed)
    base = [f"word{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(size)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(t))
    return out


def brute_components(texts, k, percent=80):
    sets = {d: {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))} for d, t in texts.items() for w in [spaced(t)]}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("chunk", [1024, 4])
def test_minhash_groups(spark, chunk):
    texts = dict(enumerate(near_texts(60, 1) + near_texts(20, 2, 90) + [" ".join(random.Random(i).choices("abcdefghij", k=40)) for i in range(20)]))
    got = minhash.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), params=minhash.Params(shingle=4, chunk=chunk))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 4)


def test_minhash_odd(spark, odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.components(odd).collect())
    assert [g for g in got if g[0] != 6] == [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (7, 1, 7, True)]
    assert minhash.components(odd.where("false")).count() == 0


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_lines(texts, percent=80, least=4):
    lines = [(d, i, frozenset(spaced(x)), x) for d in sorted(texts) for i, x in enumerate((texts[d] or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = {}
    for k, (d, i, s, _) in enumerate(lines):
        if any(100 * len(s & t) >= percent * len(s | t) for _, _, t, _ in lines[:k]):
            gone.setdefault(d, set()).add(i)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in texts.items()}


@pytest.mark.parametrize("bucket", [60_000, 50])
def test_line_dedup(spark, bucket):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    pool = near_texts(25, 3, 30) + [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 14))) for _ in range(300)]
    texts = {d: "\n".join(rng.choice(pool) if rng.random() < 0.9 else "" for _ in range(8)) for d in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, params=line_dedup.Params(bucket=bucket)).collect()} == brute_lines(texts)


def test_line_dedup_repeated_rows(spark):
    text = "a first line of seven different words\nand a second one that is longer still"
    rows = [(4, text), (4, text), (9, text + "\nown words of this document alone"), (4, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(4, text)] * 3 + [(9, "own words of this document alone")]


@pytest.mark.parametrize("p", [line_dedup.Params(hot=7, reach=2, hold=30), line_dedup.Params(hot=40, reach=3, bucket=50)])
def test_line_dedup_hot_keys(spark, p):
    rng = random.Random(5)
    pool = near_texts(25, 3, 30)
    texts = {d: "\n".join(rng.choice(pool) for _ in range(4)) for d in range(40)}
    others = [f"c{i}" for i in range(40)]  # a rare word that lines share which mostly differ
    texts |= {100 + d: "\n".join(" ".join(["rare", *rng.sample(others, rng.randrange(4, 9))]) for _ in range(5)) for d in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, params=p).collect()} == brute_lines(texts)


def test_line_dedup_many_postings_of_a_word(spark):
    # 20,000 lines of 9 of 22 words in any order: words are in thousands of prefixes, more than ``hot``
    rng, lines = random.Random(7), []
    for _ in range(20_000):
        lines.append(rng.sample(range(22), 9))
    texts = [(d, " ".join(f"w{x}" for x in line)) for d, line in enumerate(lines)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, params=line_dedup.Params(hot=2000)).collect()}
    bits = np.array([sum(1 << x for x in line) for line in lines])
    for d in range(len(lines)):
        both = np.bitwise_count(bits[:d] & bits[d]).astype(int)
        assert got[d] == int((100 * both >= 80 * (18 - both)).any())


def test_line_dedup_short_lines(spark):
    rng = random.Random(6)
    pool = ["Les.", "les. LES.", "a b", "b  a", "a b a b a", "a b c", "c b a", "a b c d", "a b c d e", "\u6ca1\u6709\u7a7a\u683c" * 9, "x"]
    texts = {d: "\n".join(rng.choice([*pool, f"own {d}", ""]) for _ in range(4)) for d in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for percent in (80, 90, 100):
        p = line_dedup.Params(percent=percent, min_words=1)
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, params=p).collect()} == brute_lines(texts, percent, 1)


def test_line_dedup_query_takes_every_line(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in queries.op2_line_dedup(spark, SF).collect()} == brute_lines(texts, least=1)


def test_line_dedup_odd(spark, odd):
    got = line_dedup.dedup_lines(odd.withColumn("n_removed", F.lit("clash")))
    rows = got.collect()
    assert len(rows) == 9 and {r.text for r in rows if r.doc_id == 1} == {None} and sum(r.n_removed for r in rows) == 0
    twice = spark.createDataFrame([(1, "a b c d\nkeep me"), (2, "a b c d\nz"), (None, "a b c d")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(twice).collect()} == {1: "a b c d\nkeep me", 2: "z", None: "a b c d"}
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


def brute_hits(text, items):
    w = alnum(text)
    hit, found = set(), set()
    for item, t in items:
        v = alnum(t)
        m = min(8, len(v))
        for j in range(len(v) - m + 1 if v else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[j : j + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontaminate(spark, odd, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(9)
    words = ["a", "b", "é", "9", "long"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(12)] + [(3, "one two"), (99, None)]
    bench = spark.createDataFrame([*items, (None, "one two")], "item_id long, text string")
    texts = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = decontaminate.digest(decontaminate.scan(docs, bench)).collect()
    assert len(rows) == 69
    for r in rows:
        if r.doc_id != 6:
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(r.text, items)
    assert decontaminate.scan(docs.where("false"), bench).count() == 0
    assert {r.n_items for r in decontaminate.scan(docs, bench.where("false")).collect()} == {0}


def test_decontaminate_splits_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    rng = random.Random(3)
    items = [(1, " ".join(f"w{rng.randrange(50)}" for _ in range(200))), (2, "Ä-b C9 d " * 31), (3, "w1 w2")]
    words = items[0][1].split()
    texts = {i: " ".join(words[i : i + rng.randrange(7, 12)]) for i in range(0, 195, 3)} | {900: items[1][1], 901: "w1 w2 w3"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in decontaminate.digest(decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"))).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(r.text, items)


def test_quality_held_out(spark, odd):
    out = queries.op4_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    r = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r > 0.97
    labels = spark.createDataFrame([(2, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)
    assert {x.score for x in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(odd, labels.where("false")).count() == 9


def test_quality_against_plain_densities(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    x = {d: quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for d, t in rows}
    part = [np.array([x[d] for d, _ in rows if y.get(d) == c]) for c in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in part]
    log = {}
    for c in (0, 1):
        m = 0.5 * own[c] + 0.5 * (own[0] + own[1]) / 2
        m = 0.9 * m + 0.1 * np.diag(np.diag(m)) + 1e-4 * np.eye(len(m))
        for d, v in x.items():
            z = v - part[c].mean(axis=0)
            log[d, c] = np.log(len(part[c])) - 0.5 * (np.linalg.slogdet(m)[1] + z @ np.linalg.solve(m, z))
    want = {d: 1 / (1 + np.exp(np.clip(log[d, 0] - log[d, 1], -700, 700))) for d in x}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 1e-6


def test_langid(spark, odd):
    out = queries.op5_langid(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    model = langid.train(odd)
    got = {(r.doc_id, r.lang_pred, r.score == 0) for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (7, "und", True)} <= got
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd.where("false")), ["doc_id"]).collect()} == {"und"}


def test_langid_labels_words(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    own = {r.lang: " ".join(re.findall(r"[^\W\d_]+", r.text)[:60]) for r in docs.where("lang in ('en', 'de') and n_chars > 1000").orderBy(F.desc("doc_id")).limit(200).collect()}
    text = f"€ 1 {own['en']}\n{own['de'][: len(own['de']) // 2]}"
    rows = [(1, text), (2, None), (3, "123 — !"), (4, "")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
    words = got[1].words
    assert [text[w.begin : w.end] for w in words] == re.findall(r"(?:[^\W\d_]|[^\x00-\x7F])+", text)
    assert got[1].lang_pred == "en" and all(0 < w.posterior <= 1 for w in words)
    cut = text.index("\n")
    for lang, part in (("en", [w for w in words if 4 <= w.begin < cut]), ("de", [w for w in words if w.begin > cut])):
        assert len(part) > 10 and sum(w.lang == lang for w in part) > 0.9 * len(part)
    assert [got[i].words for i in (2, 3, 4)] == [[], [], []]
    assert {len(r.words) for r in langid.identify(odd, None, ["doc_id"]).collect()} == {0}


def test_langid_finds_switches_within_a_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 400")
    model = langid.train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    held = [(r.lang, re.findall(r"[^\W\d_]{3,}", r.text)) for r in docs.where(crc_mod(F.col("doc_id"), 5) == 0).orderBy("doc_id").limit(120).collect()]
    rng, rows = random.Random(4), []
    for i, (a, left) in enumerate(held):
        b, right = rng.choice([x for x in held if x[0] != a])
        cut = rng.randrange(4, 9)
        rows.append((i, " ".join([*left[:cut], *right[:8]]), [a] * cut + [b] * 8))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, want array<string>"), model, ["doc_id", "want"]).collect()}
    assert np.mean([w.lang == x for r in got.values() for w, x in zip(r.words, r.want, strict=True)]) > 0.85
    # the first word of the other language is found, give or take two
    first = lambda langs: next((i for i, x in enumerate(langs) if x != langs[0]), len(langs))
    assert np.mean([abs(first([w.lang for w in r.words]) - first(r.want)) <= 2 for r in got.values()]) > 0.75
    assert all(abs(sum(x.share for x in r.shares) - 1) < 1e-6 and len(r.shares) >= 2 for r in got.values())
    off = model.trans[~np.eye(len(model.langs), dtype=bool)]
    assert (np.diag(model.trans).min() > off.max()) and np.isfinite(off).all()


def test_langid_sample_has_every_language(spark, monkeypatch):
    rows = [(i, f"{'common plain words' if i else 'seldom met speech'} {i}", "aa" if i else "zz") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample=20)
    assert model.langs == ["aa", "zz"]
    got = langid.identify(docs.where("doc_id in (0, 7)"), model, ["doc_id"])
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {0: "zz", 7: "aa"}
    # documents above the budget, the first by hash among them, neither end the sample nor make it up alone
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 900)
    first = [r.doc_id for r in docs.where("doc_id > 0").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(3).collect()]
    long = docs.withColumn("text", F.when(F.col("doc_id").isin(0, *first), F.repeat("text", 100)).otherwise(F.col("text")))
    seen = []
    monkeypatch.setattr(langid.Model, "fit", lambda texts, langs: seen.append(list(zip(langs, texts, strict=True))))
    langid.train(long, sample=20)
    assert [len(t) for lang, t in seen[0] if lang == "zz"] == [112]
    assert sum(lang == "aa" for lang, _ in seen[0]) == 16 and sum(len(t) for _, t in seen[0]) <= 900


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    u, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    c = langid.Chains(np.zeros(7, int), None, None, None, np.array([0, 4]), np.array([4, 3]))
    post, expected = langid.forward_backward(u, c, trans, True)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for start, size in ((0, 4), (4, 3)):
        total, part, two = 0.0, np.zeros((size, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * size):
            p = np.exp(sum(u[start + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, y in enumerate(path):
                part[i, y] += p
            for a, b in zip(path, path[1:], strict=False):
                two[a, b] += p
        want[start : start + size], pairs = part / total, pairs + two / total
    assert np.allclose(post, want) and np.allclose(expected, pairs)


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "https://x.example.com/en/8", "http://example.net/de/8", "http://b.net/de/1", "http://org/es/", "http://notcom/en/", "no scheme", None, "http://Q.COM/en/?x=1#y", "http://com", "http://foo.org/fr/?a=b", "x://y//z://w"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("items", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, queries.URL_RULES, ["page_id"]).collect()}
    assert [got[i][2] for i in range(8)] == ["com/en/", "example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None]
    assert got[1][3] == "allow" and got[3][3] == "block" and got[8][:2] == ("", "") and got[9][:3] == ("q.com", "/en/", "com/en/") and got[10][:2] == ("com", "") and got[12][:2] == ("y", "//z://w")
    assert url_rules.judge(pages.where("false"), queries.URL_RULES, ["page_id"]).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, [], ["page_id"]).collect()} == {"allow"}


def test_url_rules_of_the_contract(spark):
    said = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert said == queries.URL_RULES
    urls = [f"http://{sub}{host}{path}" for _, host, path in said for sub in ("", "a.") for path in (path, path + "1?x=/de/8")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, queries.URL_RULES, ["page_id"]).collect()}
    assert got == {4 * k + i: (host + path, what) for k, (what, host, path) in enumerate(said) for i in range(4)}


def test_url_mining_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = url_rules.host_and_path(F.col("url"))
    rows = pages.select(url_rules.tokens(F.col("url"), host, path).alias("items"), url_rules.rule_of(host, path, queries.URL_RULES)[1].alias("verdict")).where("verdict is not null").collect()
    from itertools import combinations

    seen, both = Counter(), Counter()
    for r in rows:
        for k in (1, 2, 3):
            for c in combinations(sorted(r["items"]), k):
                seen[c] += 1
                both[c, r.verdict] += 1
    share = Counter(r.verdict for r in rows)
    want = {(c, v) for (c, v), n in both.items() if n >= 0.01 * len(rows) and n >= 0.9 * seen[c] and n * len(rows) > seen[c] * share[v]}
    mined = url_rules.mine(spark.createDataFrame(rows))
    assert {(tuple(sorted(r.antecedent)), r.verdict) for r in mined.collect()} == want


def test_url_tokens_that_occur_together(spark):
    rows = [([f"t{i:02}" for i in range(40)] + ["x"] * (k % 2), "block" if k % 2 else "allow") for k in range(60)]
    mined = url_rules.mine(spark.createDataFrame(rows, "items array<string>, verdict string"))
    got = {tuple(r.antecedent): r.verdict for r in mined.collect()}
    assert got[("x",)] == "block" and got[("t03", "x")] == "block" and ("t00",) not in got
    assert len(got) == 1 + 40 + 40 * 39 // 2 and {r.entry for r in mined.collect()} == {"x"}


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r.doc_id: r for r in mixing.mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert {k: v.taken for k, v in a.items()} == {k: v.taken for k, v in b.items()}
    texts = {r.doc_id: r for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for k, r in a.items():
        assert r.size == len(spaced(texts[k].text)) and r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    want, free, rest = {}, set(size), 1.5 * sum(size.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2.0 * size[s] for s in full}
        rest -= sum(2 * size[s] for s in full)
        free -= full
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= 1 for s in size)
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(odd.where("false")).count() == 0
    assert {r.taken for r in mixing.mix(odd.where("doc_id in (1, 2, 3)")).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_shuffle_is_a_permutation(spark, n):
    got = spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n), F.lit(5), mixing.Params()).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\0\\1\\2", "### user: x</turn>\n", "", None, "日本 \\", "a:b # <c>"]
    rows = [(i, t, ["user", "assistant", "system", "odd: role #\n", None][(i + t) % 5], nasty[(i + t) % len(nasty)]) for i in range(12) for t in range(i)] + [(None, 0, "user", "null id"), (3, None, "assistant", "null turn"), (4, 1, "user", "a tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    back = chat_trees.read_back(chat_trees.format_paths(chat_trees.paths(chat_trees.threads(df)))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault("null" if c is None else str(c), []).append((role or "", text or ""))
    assert {r.tree: [(t.role, t.text) for t in r.turns] for r in back} == want
    assert {r.tree: r.loss_text for r in back} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    assert chat_trees.format_paths(chat_trees.paths(chat_trees.threads(df.where("false")))).count() == 0


def test_reply_tree_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("t", 5, 3, "user", "other", None), ("t", 8, 9, "user", "loop", 1.0), ("t", 9, 8, "user", "loop", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    every = {r.path: r.formatted for r in chat_trees.format_paths(chat_trees.paths(df, None)).collect()}
    assert set(every) == {2, 4, 5}
    best = chat_trees.format_paths(chat_trees.paths(df)).collect()
    assert [(r.path, r.formatted) for r in best] == [(4, "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n")]


def brute_paths(rows):
    """The best root-to-leaf path of each tree: by mean score, then by leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        of = {n: (p, role, text, s or 0.0) for t, n, p, role, text, s in rows if t == tree}
        leaves = set(of) - {p for p, *_ in of.values()}
        ways = {}
        for leaf in leaves:
            way = [leaf]
            while of[way[-1]][0] in of:
                way.append(of[way[-1]][0])
            ways[leaf] = way[::-1]
        best = min(ways, key=lambda x: (-sum(of[n][3] for n in ways[x]) / len(ways[x]), x))
        out[tree] = "".join(f"### {of[n][1]}: {of[n][2]}</turn>\n" for n in ways[best])
    return out


def test_reply_trees_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for t in range(12):
        for n in range(1, rng.randrange(2, 60)):
            rows.append((f"t{t}", n, rng.randrange(max(1, n - 4), n) if n > 1 and rng.random() < 0.97 else None, rng.choice(["user", "assistant"]), f"say {n}", rng.choice([0.25, 0.5, 1.0])))
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: r.formatted for r in chat_trees.format_paths(chat_trees.paths(df)).collect()}
    assert got == brute_paths(rows)


def test_long_conversation(spark):
    rows = spark.range(5000).selectExpr("'c' as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn #', id) as text")
    back = chat_trees.read_back(chat_trees.format_paths(chat_trees.paths(chat_trees.threads(rows)))).first()
    assert [t.text for t in back.turns] == [f"turn #{i}" for i in range(5000)] and back.loss_text == "".join(f"turn #{i}" for i in range(1, 5000, 2))


@pytest.mark.parametrize("chunk", [1024, 3])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in (base[i % 6] + 0.12 * rng.normal(size=64)).astype(np.float32)], i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [0.0] * 64, 0), (203, None, 0), (204, [float("nan")] * 64, 0), (205, rows[0][1], None), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (208, [1.0, None], 0), (209, [], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType())])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], schema), params=vector_dedup.Params(chunk=chunk)).collect()}
    good = {i: (np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (v, l) in good.items():
        for j, (w, m) in good.items():
            if i != j and l == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i].add(j)
    assert sum(map(len, links.values())) > 100
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i == min(seen))


def test_vectors_repeated_ids_and_empty(spark):
    a, b, c = [1.0, 0.0, 0.2], [1.0, 0.01, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, a, 0), (1, c, 0), (2, b, 0), (3, c, 0), (4, a, 1), (None, a, 0), (5, [0.0, -0.0, 1.0], 0), (6, [0.0, 0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(-1, 0, None), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5)]
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


PAGES = {
    "<p>One<p>Two": "One\n\nTwo",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<ol start=3><li>a</li><li>b</li></ol>x": "3. a\n4. b\n\nx",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name      | N\nlong name | 1",
    "<div>a</div><div>b <b>c</b>  d</div>": "a\nb c d",
    "<head><title>t</title><style>.x{display:none}</style></head><body><p class=x>no</p><p hidden>no</p><p style='visibility: hidden'>no</p>yes<script>1<2</script></body>": "yes",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "a<br>b&amp;c &lt;": "a\nb&c <",
    "<details><summary>s</summary>gone</details>": "s",
    "plain < text": "plain < text",
    "<!-- c --><p>x</p><!-- open": "x",
}


SHOWN = {
    "<p>so <math><semantics><mrow><mi>x</mi> <mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>\\frac</annotation></semantics></math> holds": "so x=1/2 holds",
    "<p>a <svg><title>t</title><desc>d</desc><defs><text>no</text></defs><rect/><clipPath/><g>no<text>Label <tspan>one</tspan></text><text>two</text></g></svg> b": "a Label one two b",
    "<svg><g><text>x</text><p>out</p>": "x\n\nout",
    "<p>of <select><option>first<option selected>shown<option>third</select> it": "of shown it",
    "<select><option disabled>pick<optgroup label=g><option>a<option>b</select>": "a",
    "<select multiple><option>a<option label=B>b</select>": "a B",
    "<style>@media print{.side{display:none}} @media (max-width:600px){.side{display:none}}</style><p class=side>seen": "seen",
    "<style>@media screen and (min-width: 40em){.x{display:none}}</style><p class=x>no<p>yes": "yes",
    "<style>@media not all and (width < 600px), print{.x{display:none}}</style><p class=x>no<p>yes": "yes",
    "<style>.x{display:none}@media (600px <= width){.x{display:block}}</style><p class=x>seen": "seen",
    "<style media=print>p{display:none}</style><p>seen": "seen",
    "<style>@keyframes k{from{visibility:hidden}} @import 'a;b'; @layer a{@supports (display:grid){.x{color:red;display:none}}}</style><from>seen</from><b class=x>no": "seen",
    "<style>.x{color:red; .y{display:none} @media print{display:none}}</style><p class=x>seen": "seen",
}


@pytest.mark.parametrize("html,text", SHOWN.items())
def test_html_shown(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize("html,text", PAGES.items())
def test_html(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize("n", [300, 20_000])
def test_html_deep(n):
    hidden = "<div>" * n + "<div hidden>no<div>no</div>no</div>yes" + "</div>" * n + "<p>after"
    assert html_extract.extract(hidden) == "yes\n\nafter"
    assert html_extract.extract("<b>" * n + "<script>no</script><i hidden>no</i>x" + "</b>" * n) == "x"
    table = "<div>" * n + "<ul><li>a<li>b</ul><table><tr><td>long<td>2<tr><td>s<td>3</table>"
    assert html_extract.extract(table) == "- a\n- b\n\nlong | 2\ns    | 3"
    m = min(n, 1000)
    assert html_extract.extract("<ul><li>" * m + "x") == "- " * m + "x"
    assert html_extract.extract("<blockquote>" * m + "x") == "> " * m + "x"
    assert html_extract.extract("<ul><li>a" * m) == "\n".join("  " * i + "- a" for i in range(m))
    assert html_extract.extract("<table><tr><td>" * m + "x") == "x"


VISIBLE = {
    "<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>": "yes",
    "<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>no<p class=v>yes<i class=h>no</i></div>": "yes",
    "<style>.h{display:none}</style><p class=h style='display:block'>yes<p class=h>no": "yes",
    "<style>.h{display:none !important}</style><p class=h style='display:block'>no<p>yes": "yes",
    "<ol><li>a<li style='visibility:hidden'>no<li>c</ol>": "1. a\n3. c",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a | b\n  | c\nd | e",
    "<table><tr><td colspan=2>both<td>x<tr><td>one<td>two<td rowspan=9>y<tr><td>three</table>": "both        | x\none   | two | y\nthree |     |",
    "<p title='a>b' alt=\"<i>\">x</p>": "x",
    "<p class=\"a\"\">x</p>y": "x\n\ny",
    "x<a href=": "x",
}


@pytest.mark.parametrize("html,text", VISIBLE.items())
def test_html_visible(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<a '>'", "</b ", "<script>", "</script ", "<!--", "<b><i></b>", "<svg><p>", "<td rowspan=9 colspan=999>x", "<p a='"])
def test_html_takes_linear_time(piece):
    began = time.process_time()
    html_extract.extract("<table><tr><td>x" + piece * (1_000_000 // len(piece) // (1 if piece[1] != "t" else 20)))
    assert time.process_time() - began < 20  # a scan that starts over at each tag takes hours


class Words(HTMLParser):
    """Words of the text nodes that no element or attribute hides, found without a tree: the other way to read the test pages."""

    def __init__(self, page):
        super().__init__()
        self.off, self.found = 0, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        gone = tag in ("script", "style", "head", "noscript", "template") or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
        if tag not in html_extract.VOID and (self.off or gone):
            self.off += 1

    def handle_endtag(self, tag):
        self.off = max(0, self.off - 1)

    def handle_data(self, data):
        if not self.off:
            self.found += re.findall(r"\w+", data)


def test_html_against_another_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = 0
    for page in pages:
        got, want = Counter(re.findall(r"\w+", html_extract.extract(page))), Counter(Words(page).found)
        same += not (want - got)
        assert sum((want - got).values()) <= 0.02 * sum(want.values()) + 3
    assert same >= 0.9 * len(pages)


def test_html_odd(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "<div>" * 5000 + "deep"), (4, "x" * 200_000), (None, "<p>y")]
    got = [(r.page_id, r.text) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]).collect()]
    assert got == [(1, ""), (1, ""), (2, ""), (3, "deep"), (4, "x" * 200_000), (None, "y")]
    assert html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, html string").where("false"), ["page_id"]).count() == 0
