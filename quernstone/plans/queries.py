"""Registered queries over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month, pattern_text
from ..operators import aggregations as A
from ..operators import facets as FA
from ..operators import ingest as I
from ..operators import patterns as P
from ..operators import retrieval as R
from ..operators import text as T
from ..session import at_hand, keep
from . import evaluate as E
from . import fixtures as X
from .parser import parse
from .search import vector_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# the fixture mapping once more, for the other engine
_DOMAIN = "CASE p_type WHEN 'ECONOMY' THEN 'drainage' WHEN 'STANDARD' THEN 'sanitation' WHEN 'PROMO' THEN 'water_supply' WHEN 'SMALL' THEN 'street_infrastructure' WHEN 'MEDIUM' THEN 'other' END"
_AGENCIES = "CASE WHEN p_type = 'ECONOMY' THEN ['DEP', 'DSNY', 'DOT'] WHEN p_type = 'STANDARD' THEN ['DSNY'] WHEN p_type = 'PROMO' THEN ['DEP', 'DOT'] WHEN starts_with(p_name, 'blue') THEN ['DPR'] ELSE CAST([] AS VARCHAR[]) END"
_TEXT = "concat_ws('. ', nullif(trim(p_type), ''), nullif(trim(p_name), ''))"
_RECORDS = f"""rec AS (SELECT l_orderkey AS key, l_linenumber AS line, p_type AS category, p_name AS descriptor, {_TEXT} AS pattern, n_name AS board, r_name AS borough,
  l_shipdate AS created, o_orderpriority AS agency, {_DOMAIN} AS domain, {_AGENCIES} AS agencies, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
_PATTERNS = f"""cnt AS (SELECT {_TEXT} AS pattern, p_type AS category, p_name AS descriptor, count(*) AS record_count, {_DOMAIN} AS domain, {_AGENCIES} AS agencies FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
pat AS (SELECT c.*, CAST(embedding AS DOUBLE[]) AS e FROM (SELECT *, row_number() OVER (ORDER BY pattern) - 1 AS vec_id FROM cnt) c JOIN embeddings USING (vec_id))"""
_QUERY = "qv AS (SELECT list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS q FROM (SELECT list_transform(list_zip(a.e, b.e), lambda z: z[1] + z[2]) AS s FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 3) a, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 11) b))"
_SIM = "sim AS (SELECT pat.*, list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) AS sim FROM pat, qv)"
TOPIC = "category = 'ECONOMY'"


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _chosen(spark, d) -> DataFrame:
    """The topic's patterns."""
    return X.counts(spark, d).where(TOPIC).select("pattern")


def _base(spark, d) -> DataFrame:
    return A.on_topic(X.records(spark, d), _chosen(spark, d))


_TOPIC_SQL = f"WITH {_RECORDS}, base AS (SELECT * FROM rec WHERE category = 'ECONOMY')"


@register(f"{_TOPIC_SQL}, g AS (SELECT board AS district, count(*) AS count FROM base GROUP BY board) SELECT row_number() OVER (ORDER BY count DESC, district) AS rank, district, count FROM g ORDER BY rank LIMIT 10")
def topn_districts(spark, d):
    return A.topn(_base(spark, d), 10)


@register(f"""{_TOPIC_SQL}, c AS (SELECT board, category, count(*) AS category_count FROM base GROUP BY ALL), t AS (SELECT board, sum(category_count) AS district_count FROM c GROUP BY board ORDER BY 2 DESC, 1 LIMIT 30),
r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY category_count DESC, category) AS place FROM c)
SELECT t.board AS district, CAST(district_count AS BIGINT) AS district_count, category, category_count, place FROM t LEFT JOIN r ON t.board = r.board AND place <= 8""")
def distribution_by_district(spark, d):
    return A.distribution(_base(spark, d))


@register(f"""WITH {_RECORDS}, base AS (SELECT * FROM rec WHERE borough = 'ASIA' AND created >= TIMESTAMP '1996-01-01'), c AS (SELECT board, category, count(*) AS category_count FROM base GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY category_count DESC, category) AS place, sum(category_count) OVER (PARTITION BY board) AS n FROM c)
SELECT board AS district, CAST(n AS BIGINT) AS district_count, category, category_count, place FROM r WHERE place <= 3""")
def categories_in_borough(spark, d):
    return A.distribution(A.filtered(X.records(spark, d), "ASIA", "1996-01-01"), categories=3)


@register(f"{_TOPIC_SQL} SELECT key, line, created, category, descriptor, borough, board, agency, price, count(*) OVER () AS total FROM base WHERE board = 'NATION_3' ORDER BY created DESC, key, line, price LIMIT 20")
def drilldown_records(spark, d):
    return A.drill_down(_base(spark, d), "NATION_3", 20, tie=("key", "line", "price"), columns=["key", "line", "created", "category", "descriptor", "borough", "board", "agency", "price"])


@register(f"WITH {_RECORDS} SELECT agency, count(*) AS count FROM rec WHERE category = 'ECONOMY' GROUP BY agency ORDER BY 2 DESC, 1 LIMIT 7")
def agency_routed(spark, d):
    return A.routed(_base(spark, d))


@register(f"WITH {_RECORDS}, u AS (SELECT unnest(list_distinct(agencies)) AS agency FROM rec) SELECT agency, count(*) AS count FROM u GROUP BY agency ORDER BY 2 DESC, 1 LIMIT 7")
def agency_involved(spark, d):
    return A.involved(X.records(spark, d))


@register(f"WITH {_PATTERNS} SELECT CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(CASE WHEN len(agencies) >= 2 THEN record_count ELSE 0 END) AS BIGINT) AS multi, round(sum(CASE WHEN len(agencies) >= 2 THEN record_count ELSE 0 END) / sum(record_count), 4) AS share FROM cnt")
def multi_agency_share(spark, d):
    x = X.counts(spark, d)
    return FA.multi_agency_share(x.select("pattern", X.agencies_of(F.col("category"), F.col("descriptor")).alias("agencies")), x.select("pattern", "record_count"))


_MONTHLY = f"""{_TOPIC_SQL}, b AS (SELECT board, count(*) AS total FROM base GROUP BY board HAVING count(*) >= 30 ORDER BY 2 DESC, 1 LIMIT 60),
c AS (SELECT board, date_trunc('month', created)::DATE AS month, count(*) AS n FROM base GROUP BY ALL), s AS (SELECT board, min(month) AS x, max(month) AS y FROM c GROUP BY board),
m AS (SELECT b.board, b.total, CAST(unnest(generate_series(x::TIMESTAMP, y::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM s JOIN b USING (board)),
mm AS (SELECT m.board AS district, total, month, coalesce(n, 0) AS count FROM m LEFT JOIN c USING (board, month))"""


@register(f"{_MONTHLY} SELECT * FROM mm")
def trend_monthly(spark, d):
    return A.monthly(_base(spark, d))


@register(f"""{_MONTHLY}, i AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY month) AS i, count(*) OVER (PARTITION BY district) AS n FROM mm),
h AS (SELECT district, max(total) AS count, CAST(sum(CASE WHEN i <= n // 2 THEN count ELSE 0 END) AS BIGINT) AS first_half, CAST(sum(CASE WHEN i > n // 2 THEN count ELSE 0 END) AS BIGINT) AS second_half FROM i WHERE n >= 4 GROUP BY district)
SELECT *, round((second_half - first_half) / greatest(first_half, 1), 3) AS growth FROM h ORDER BY growth DESC, count DESC, district LIMIT 15""")
def trend_growth(spark, d):
    return A.trend(_base(spark, d))


_CELLS = f"{_TOPIC_SQL}, cells AS (SELECT * FROM (SELECT board, date_trunc('month', created)::DATE AS month, count(*) AS count FROM base GROUP BY ALL ORDER BY 1, 2 LIMIT 100) WHERE count >= 5)"


@register(f"{_CELLS} SELECT * FROM cells")
def cooccurrence_cells(spark, d):
    return A.cells(_base(spark, d))


@register(f"{_TOPIC_SQL} SELECT * FROM (SELECT board, date_trunc('month', created)::DATE AS month, count(*) AS count FROM base GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 100) WHERE count >= 5")
def cooccurrence_cells_largest(spark, d):
    return A.cells(_base(spark, d), mode="largest")


def _cube(spark, d) -> DataFrame:
    return keep(A.cube(X.records(spark, d)), "cube")


def _cells(cube: DataFrame, chosen: DataFrame) -> DataFrame:
    return at_hand(A.cells(A.on_topic(cube, chosen)), 100)


_INSIDE = "ins AS (SELECT * FROM rec WHERE category <> 'ECONOMY' AND (board, date_trunc('month', created)::DATE) IN (SELECT (board, month) FROM cells))"


@register(f"""{_CELLS}, {_INSIDE}, top AS (SELECT pattern, count(*) AS count FROM ins GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 15),
city AS (SELECT pattern, count(*) AS c FROM rec WHERE category <> 'ECONOMY' GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 300)
SELECT pattern, count, round(count / (SELECT greatest(count(*), 1) FROM ins), 4) AS share_in_cells,
  round((count / (SELECT greatest(count(*), 1) FROM ins)) / (c / (SELECT count(*) FROM rec WHERE category <> 'ECONOMY')), 2) AS lift_vs_citywide FROM top LEFT JOIN city USING (pattern)""")
def cooccurrence_lift(spark, d):
    cube, chosen = _cube(spark, d), _chosen(spark, d)
    return A.cooccurrence(cube, cube, chosen, _cells(cube, chosen))


@register(f"{_CELLS}, {_INSIDE} SELECT domain, count(*) AS count FROM ins WHERE domain IS NOT NULL GROUP BY domain ORDER BY 2 DESC, 1 LIMIT 6")
def cooccurrence_domains(spark, d):
    cube, chosen = _cube(spark, d), _chosen(spark, d)
    return A.domains_inside(cube, chosen, _cells(cube, chosen))


@register(f"WITH {_PATTERNS} SELECT pattern, category, descriptor, record_count FROM cnt")
def pattern_counts(spark, d):
    return X.counts(spark, d)


_PENDING = f"""WITH {_RECORDS} SELECT pattern AS embed_text, category, descriptor, count(*) AS record_count, string_agg(DISTINCT agency, ', ' ORDER BY agency) AS raw_agencies
FROM rec WHERE category NOT IN ('SMALL', 'LARGE') GROUP BY ALL ORDER BY record_count DESC, embed_text"""


def _pending(spark, d, limit=None) -> DataFrame:
    rec = X.records(spark, d).withColumnRenamed("pattern", "embed_text")
    done = X.counts(spark, d).where("category in ('SMALL', 'LARGE')").select(F.col("pattern").alias("embed_text"), F.lit(False).alias("needs_review"))
    return P.pending(P.combos(rec, ["category", "descriptor"]), done, limit=limit)


@register(f"{_PENDING} LIMIT 50")
def pending_combos(spark, d):
    return _pending(spark, d, 50)


@register(_PENDING)
def pending_combos_all(spark, d):
    return _pending(spark, d)


@register(f"WITH {_PATTERNS} SELECT pattern AS embed_text FROM cnt WHERE category <> 'PROMO'")
def missing_texts(spark, d):
    c = X.counts(spark, d).withColumnRenamed("pattern", "embed_text")
    return P.missing_texts(X.records(spark, d).withColumnRenamed("pattern", "embed_text"), c.where("category = 'PROMO'").select("embed_text", F.lit("m").alias("model")), "m")


@register(f"WITH {_RECORDS}, {_PATTERNS} SELECT pat.vec_id, rec.board, count(*) AS records, round(sum(e[1]), 4) AS first_component FROM rec JOIN pat USING (pattern) GROUP BY ALL")
def fanout_vectors(spark, d):
    cache = X.patterns(spark, d).select(F.col("pattern").alias("embed_text"), "vec_id", "embedding")
    x = X.records(spark, d).withColumnRenamed("pattern", "embed_text").join(cache, "embed_text")
    return x.groupBy("vec_id", "board").agg(F.count("*").alias("records"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first_component"))


@register(f"WITH {_RECORDS}, f AS (SELECT DISTINCT pattern, domain AS d FROM rec WHERE category <> 'MEDIUM') SELECT coalesce(f.d, 'none') AS domain, board, count(*) AS records FROM rec LEFT JOIN f USING (pattern) GROUP BY ALL")
def fanout_facets(spark, d):
    f = X.counts(spark, d).where("category <> 'MEDIUM'").select("pattern", X.domain_of(F.col("category")).alias("d"))
    return X.records(spark, d).join(f, "pattern", "left").groupBy(F.coalesce("d", F.lit("none")).alias("domain"), "board").agg(F.count("*").alias("records"))


@register(f"WITH {_PATTERNS} SELECT pattern AS embed_text, CASE WHEN descriptor = 'blue anvil' THEN 'structural_damage' WHEN category = 'ECONOMY' THEN 'blockage' END AS failure_mode, CASE WHEN descriptor = 'blue anvil' THEN 'v2' ELSE 'v1' END AS prompt_version FROM cnt")
def overrides_applied(spark, d):
    c = X.counts(spark, d)
    facets = c.select(F.col("pattern").alias("embed_text"), F.when(F.expr(TOPIC), "blockage").alias("failure_mode"), F.lit("v1").alias("prompt_version"))
    o = c.where("descriptor = 'blue anvil'").select(F.col("pattern").alias("embed_text"), F.lit("structural_damage").alias("failure_mode"), F.lit("v2").alias("prompt_version"))
    return P.apply_overrides(facets, o, ["failure_mode", "prompt_version"])


def _odd_facets(spark, d) -> DataFrame:
    return X.counts(spark, d).select(
        F.col("pattern").alias("embed_text"),
        X.domain_of(F.col("category")).alias("problem_domain"),
        F.when(F.startswith("descriptor", F.lit("blue")), "blockage").when(F.startswith("descriptor", F.lit("cold")), "melting").alias("failure_mode"),
        F.when(F.col("descriptor") == "red rod", F.array(F.lit("FBI"))).otherwise(X.agencies_of(F.col("category"), F.col("descriptor"))).alias("agencies_involved"),
        F.lit(False).alias("needs_review"),
    )


@register(f"""WITH {_PATTERNS}, f AS (SELECT pattern AS embed_text, domain AS pd, CASE WHEN starts_with(descriptor, 'blue') THEN 'blockage' WHEN starts_with(descriptor, 'cold') THEN 'melting' END AS fm, CASE WHEN descriptor = 'red rod' THEN ['FBI'] ELSE agencies END AS ag FROM cnt)
SELECT embed_text, concat_ws(',', CASE WHEN fm IS NOT NULL AND fm NOT IN ('blockage', 'overflow', 'structural_damage', 'odor', 'debris', 'service_gap') THEN 'mode' END, CASE WHEN fm IS NOT NULL AND pd NOT IN ('drainage', 'sanitation') THEN 'mode_domain' END,
  CASE WHEN len(list_filter(ag, lambda a: a NOT IN ('DSNY', 'DEP', 'DOT', 'HPD', 'NYPD', 'DOHMH', 'DPR'))) > 0 THEN 'agencies' END, CASE WHEN pd IS NULL THEN 'reviewed_complete' END) AS violations FROM f""")
def facet_violations(spark, d):
    return _odd_facets(spark, d).select("embed_text", F.concat_ws(",", FA.store_violations()).alias("violations"))


@register(f"""WITH {_PATTERNS}, f AS (SELECT pattern AS embed_text, domain AS pd, CASE WHEN starts_with(descriptor, 'blue') THEN 'blockage' WHEN starts_with(descriptor, 'cold') THEN 'melting' END AS fm, CASE WHEN descriptor = 'red rod' THEN ['FBI'] ELSE agencies END AS ag FROM cnt)
SELECT embed_text, CAST((CASE WHEN pd IN ('drainage', 'sanitation') AND fm IS NULL THEN 1 ELSE 0 END) + (CASE WHEN pd NOT IN ('drainage', 'sanitation') AND fm IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN len(ag) < 1 THEN 1 ELSE 0 END) AS INTEGER) AS errors FROM f""")
def answer_errors(spark, d):
    return _odd_facets(spark, d).select("embed_text", F.size(FA.answer_errors()).alias("errors"))


@register("""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, nullif(event_type, '') AS event_type, CAST(replace(printf('%,.2f', value), ',', '') AS DOUBLE) AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m') AS month FROM events""")
def clean_cast_events(spark, d):
    from ..functions.columns import any_timestamp, blank_to_null, grouped_double, iso

    raw = X.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("ts"), "event_type", F.format_number("value", 2).alias("value"), "props")
    t = any_timestamp(F.col("ts"))
    return raw.select(blank_to_null(F.col("id")).cast("bigint").alias("event_id"), t.alias("ts"), blank_to_null(F.col("event_type")).alias("event_type"), grouped_double(F.col("value")).alias("value"), F.from_json("props", "k bigint")["k"].alias("k"), iso(t).alias("iso"), F.date_format(t, "yyyy-MM").alias("month"))


@register("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, 'first' AS source FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, 'X' AS o_orderstatus, 'second' AS source FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, coalesce(o.source, n.source) AS source FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert_orders(spark, d):
    o = X.table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("first").alias("source"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"), F.lit("second").alias("source"))
    return I.upsert(old, new, "o_orderkey", keep=("source",))


@register("""SELECT 'pull' AS id, greatest(max(ts), TIMESTAMP '2024-01-10') AS last_created_date, CAST(7 + count(*) AS BIGINT) AS rows_pulled FROM events WHERE ts > TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view')""")
def incremental_watermark(spark, d):
    mark = datetime(2024, 1, 10)
    state = spark.createDataFrame([("pull", mark, 7)], "id string, last_created_date timestamp_ntz, rows_pulled bigint")
    return I.advance(state, I.since(X.table(spark, d, "events"), mark, "ts", ["click", "view"], "event_type"), "pull", datetime(2023, 1, 1), "ts")


def _q(spark, d):
    return vector_column(X.vector(spark, d, 3, 11))


@register(f"WITH {_PATTERNS}, {_QUERY}, {_SIM} SELECT pattern, row_number() OVER (ORDER BY sim DESC, pattern) AS rank, round(sim, 4) AS sim FROM sim ORDER BY sim DESC, pattern LIMIT 50")
def knn_topk(spark, d):
    return R.nearest(X.patterns(spark, d), _q(spark, d), 50).withColumn("sim", F.round("sim", 4))


@register(f"""WITH {_RECORDS}, {_PATTERNS}, {_QUERY}, {_SIM}, near AS (SELECT rec.descriptor, rec.pattern, s.sim, key, line, price FROM rec JOIN sim s ON rec.pattern = s.pattern ORDER BY s.sim DESC, rec.pattern, key, line, price LIMIT 400),
best AS (SELECT *, row_number() OVER (PARTITION BY descriptor ORDER BY sim DESC, pattern, key, line, price) AS n FROM near)
SELECT descriptor, pattern, key, round(sim, 4) AS sim, row_number() OVER (ORDER BY sim DESC, pattern, key, line, price) AS rank FROM best WHERE n = 1 ORDER BY rank LIMIT 10""")
def record_knn_collapsed(spark, d):
    near = R.similarity(X.patterns(spark, d).select("pattern", "embedding"), _q(spark, d)).select("pattern", "sim")  # once a pattern, not a record
    x = X.records(spark, d).select("pattern", "descriptor", "key", "line", "price").join(near, "pattern")
    return R.collapsed(x, "descriptor", tie=("pattern", "key", "line", "price")).select("descriptor", "pattern", "key", F.round("sim", 4).alias("sim"), "rank")


@register(f"""WITH {_PATTERNS}, {_QUERY}, {_SIM}, x AS (SELECT *, greatest(0.2, (SELECT max(sim) FROM sim) - 0.5) AS lim, contains(lower(pattern), 'blue') AND contains(lower(pattern), 'anvil') AS lex FROM sim)
SELECT pattern, round(sim, 4) AS sim, CASE WHEN sim >= lim THEN 'vector' ELSE 'lexical' END AS via, row_number() OVER (ORDER BY sim DESC, pattern) AS rank FROM x WHERE sim >= lim OR lex ORDER BY sim DESC, pattern LIMIT 25""")
def pattern_select(spark, d):
    return R.select_patterns(X.patterns(spark, d), _q(spark, d), F.lit("the Blue anvil problems"), floor=0.2, window=0.5)


def _plain(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern", "record_count", *[T.plain_tokens(F.col(c)).alias(a) for c, a in (("pattern", "full_text"), ("category", "category"), ("descriptor", "descriptor"))])


_FIELDS = {"full_text": 2.0, "category": 1.0, "descriptor": 1.0}
_BM25 = """f AS (SELECT pattern, record_count AS w, fld, boost, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS tok FROM (
  SELECT pattern, record_count, 'full_text' AS fld, 2.0 AS boost, pattern AS t FROM cnt UNION ALL SELECT pattern, record_count, 'category', 1.0, category FROM cnt UNION ALL SELECT pattern, record_count, 'descriptor', 1.0, descriptor FROM cnt)),
st AS (SELECT fld, sum(w) AS n_all, sum(w * len(tok)) / sum(w) AS avg_len FROM f WHERE len(tok) > 0 GROUP BY fld),
h AS (SELECT pattern, fld, any_value(w) AS w, any_value(len(tok)) AS len, any_value(boost) AS boost, term, count(*) AS tf FROM (SELECT *, unnest(tok) AS term FROM f) WHERE term IN ('blue', 'anvil', 'economy') GROUP BY pattern, fld, term),
df AS (SELECT fld, term, sum(w) AS n FROM h GROUP BY ALL),
s AS (SELECT pattern, fld, sum(boost * ln(1 + (n_all - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s FROM h JOIN df USING (fld, term) JOIN st USING (fld) GROUP BY ALL),
bm AS (SELECT pattern, max(s) AS score FROM s GROUP BY pattern)"""


def _lexical(spark, d) -> DataFrame:
    return T.bm25(_plain(X.counts(spark, d)), ["blue", "anvil", "economy"], _FIELDS).withColumn("score", F.round("score", 9))


@register(f"WITH {_PATTERNS}, {_BM25} SELECT pattern, round(score, 4) AS score FROM bm ORDER BY round(score, 9) DESC, pattern LIMIT 100")
def bm25_topk(spark, d):
    return _lexical(spark, d).orderBy(F.desc("score"), "pattern").limit(100).withColumn("score", F.round("score", 4))


# in the fixture's vocabulary the question's stems stand for just the words that the plain query asks for
@register(f"WITH {_PATTERNS}, {_BM25} SELECT pattern, round(score, 4) AS score FROM bm ORDER BY round(score, 9) DESC, pattern LIMIT 100")
def bm25_stemmed(spark, d):
    p = X.counts(spark, d)
    tokens = T.analyse(p.select("pattern", "record_count", F.col("pattern").alias("full_text"), "category", "descriptor"), ["full_text", "category", "descriptor"])
    found = T.bm25(tokens, T.english_tokens("blue anvils in the economy"), _FIELDS).withColumn("score", F.round("score", 9))
    return found.orderBy(F.desc("score"), "pattern").limit(100).withColumn("score", F.round("score", 4))


_FUSED = f"""{_PATTERNS}, {_QUERY}, {_SIM}, {_BM25}, l0 AS (SELECT pattern, row_number() OVER (ORDER BY round(score, 9) DESC, pattern) AS r FROM bm), l1 AS (SELECT pattern, row_number() OVER (ORDER BY sim DESC, pattern) AS r FROM sim),
legs AS (SELECT pattern, r, 0 AS leg FROM l0 WHERE r <= 100 UNION ALL SELECT pattern, r, 1 FROM l1 WHERE r <= 50),
fu AS (SELECT pattern, sum(1.0 / (60 + r)) AS rrf, min(leg * 1000 + r) AS seen, max(CASE WHEN leg = 0 THEN r END) AS rank_0, max(CASE WHEN leg = 1 THEN r END) AS rank_1 FROM legs GROUP BY pattern),
fused AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, seen) AS place FROM fu),
fd AS (SELECT fused.*, domain FROM fused JOIN pat USING (pattern)),
votes AS (SELECT domain, round(sum(1.0 / place), 12) AS v, min(place) AS p FROM fd WHERE place <= 10 AND domain IS NOT NULL GROUP BY domain),
ag AS (SELECT domain AS agreed FROM votes ORDER BY v DESC, p LIMIT 1),
re AS (SELECT pattern, domain, agreed, place AS before, CASE WHEN domain = agreed THEN rrf ELSE rrf * 0.75 END AS score FROM fd, ag),
rr AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, before) AS place FROM re)"""


def _fused(spark, d) -> DataFrame:
    legs = at_hand(R.ranked(_lexical(spark, d), 100), 100), at_hand(R.nearest(X.patterns(spark, d), _q(spark, d), 50), 50)
    return at_hand(R.fuse(*legs), 150)


@register(f"WITH {_FUSED} SELECT pattern, round(rrf, 5) AS rrf, place, rank_0, rank_1 FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("rrf", F.round("rrf", 5))


@register(f"WITH {_FUSED} SELECT pattern, domain, agreed, round(score, 5) AS score, place FROM rr")
def consensus_rerank(spark, d):
    return R.consensus(_fused(spark, d), X.patterns(spark, d)).select("pattern", "domain", "agreed", F.round("score", 5).alias("score"), "place")


@register(f"""WITH {_RECORDS}, {_FUSED}, rep AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY created DESC, key, line, price) AS n FROM rec WHERE borough = 'EUROPE')
SELECT rr.place, pattern, key, line, price, created FROM rr JOIN rep USING (pattern) WHERE n = 1 AND rr.place <= 20 ORDER BY rr.place LIMIT 10""")
def hybrid_representatives(spark, d):
    scored = at_hand(R.consensus(_fused(spark, d), X.patterns(spark, d)).drop("domain"), 150)
    return R.representatives(scored, X.records(spark, d).where("borough = 'EUROPE'"), 10, ("key", "line", "price")).select("place", "pattern", "key", "line", "price", "created")


def _eval_queries(spark, d) -> DataFrame:
    return X.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_TOPS = f"""{_PATTERNS}, eq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
tops AS (SELECT query_id, pattern, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) DESC, pattern) AS rank FROM pat, eq)"""


@register(f"""WITH {_TOPS}, p8 AS (SELECT pattern, list_transform(e, lambda x: floor(x * 127 / m + 0.5) * m / 127) AS e FROM (SELECT pattern, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM pat)),
t8 AS (SELECT query_id, pattern, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) DESC, pattern) AS rank FROM p8, eq),
a AS (SELECT query_id, pattern FROM tops WHERE rank <= 10), b AS (SELECT query_id, pattern FROM t8 WHERE rank <= 10) SELECT query_id, round(count(b.pattern) / 10, 4) AS recall FROM a LEFT JOIN b USING (query_id, pattern) GROUP BY query_id""")
def served_recall_at_10(spark, d):
    q, p = _eval_queries(spark, d), X.patterns(spark, d)
    return E.recall(E.top_lists(q, p), E.top_lists(q, E.quantised(p)))


@register(f"""WITH {_TOPS}, lab AS (SELECT query_id, pattern, CASE WHEN category = 'PROMO' THEN 1 ELSE 0 END AS label FROM eq, cnt WHERE category <> 'LARGE')
SELECT query_id, round(sum(coalesce(label, 0)) / 10, 4) AS precision, count(*) AS served, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END)::BIGINT AS unjudged FROM tops LEFT JOIN lab USING (query_id, pattern) WHERE rank <= 10 GROUP BY query_id""")
def precision_at_10(spark, d):
    q, p = _eval_queries(spark, d), X.patterns(spark, d)
    labels = E.meet(q.select("query_id"), p.where("category <> 'LARGE'")).select("query_id", "pattern", F.when(F.col("category") == "PROMO", " 1").otherwise("0 ").alias("label"))
    return E.precision(E.top_lists(q, p), E.read_labels(labels))


@register()
def pooled_candidates(spark, d):
    q, p = _eval_queries(spark, d), X.patterns(spark, d)
    top = E.top_lists(q, p, 15)
    return E.pool({"knn": top, "hybrid": top.where("rank <= 10")}, p, q)


# The canonical questions.
QUESTIONS = ["Where in Brooklyn is stormwater not draining?", "Which agencies does a single catch-basin complaint actually involve?", "Which district's drainage complaints grew fastest last year?", "Top 10 districts for catch-basin clogging citywide?", "What problems tend to co-occur with catch-basin clogging?"]


@register("""SELECT * FROM (VALUES
('Where in Brooklyn is stormwater not draining?', 'stormwater not draining', 'borough', 'BROOKLYN', 'community_board', NULL, 'distribution', NULL, ['geo:borough=BROOKLYN', 'geo:group_by_district', 'agg:distribution']),
('Which agencies does a single catch-basin complaint actually involve?', 'single catch-basin', NULL, NULL, NULL, NULL, 'agency_facets', NULL, ['agg:agency_facets']),
('Which district''s drainage complaints grew fastest last year?', 'drainage', NULL, NULL, 'community_board', '2025-07-01', 'trend', NULL, ['time:past_year', 'agg:trend', 'geo:group_by_district']),
('Top 10 districts for catch-basin clogging citywide?', 'catch-basin clogging', 'citywide', NULL, 'community_board', NULL, 'topn', 10, ['geo:citywide', 'agg:topn', 'geo:group_by_district']),
('What problems tend to co-occur with catch-basin clogging?', 'problems tend to with catch-basin clogging', NULL, NULL, NULL, NULL, 'cooccurrence', NULL, ['agg:cooccurrence'])
) t(question, topic, scope, borough, group_by, gte, type, top_n, matched_rules)""")
def parse_queries(spark, d):
    rows = [(q, p.topic, p.geo.scope, p.geo.borough, p.geo.group_by, p.time_range and p.time_range.gte, p.aggregation and p.aggregation.type, p.aggregation and p.aggregation.top_n, list(p.matched_rules)) for q in QUESTIONS for p in [parse(q, date(2026, 7, 1))]]
    return spark.createDataFrame(rows, "question string, topic string, scope string, borough string, group_by string, gte string, type string, top_n int, matched_rules array<string>")


@register("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def monthly_counts(spark, d):
    return X.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz")).groupBy(F.date_format(month(F.col("l_shipdate")), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@register("SELECT DISTINCT concat_ws('. ', nullif(trim(p_type), ''), nullif(trim(p_name), '')) AS pattern, p_type || ' / ' || p_name AS shown FROM part")
def short_patterns(spark, d):
    from ..functions.columns import short_pattern

    return X.table(spark, d, "part").select(pattern_text(F.col("p_type"), F.col("p_name")).alias("pattern")).distinct().withColumn("shown", short_pattern(F.col("pattern")))


@register(f"WITH {_RECORDS} SELECT pattern, count(*) AS count FROM rec GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 500")
def pattern_universe(spark, d):
    return A.top_groups(X.records(spark, d), "pattern", 500)


@register(f"""WITH {_RECORDS}, c AS (SELECT pattern, agency, count(*) AS count FROM rec GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY count DESC, agency) AS place, CAST(sum(count) OVER (PARTITION BY pattern) AS BIGINT) AS total FROM c)
SELECT pattern, agency, count, place, total FROM r WHERE place <= 3""")
def routed_by_pattern(spark, d):
    return A.routed_by(X.records(spark, d))


@register(f"""WITH {_PATTERNS}, {_QUERY}, {_SIM}, a AS (SELECT pattern, row_number() OVER (ORDER BY sim DESC, pattern) AS rank_with FROM sim),
o AS (SELECT pattern, list_sum(list_transform(list_zip(pat.e, x.e), lambda z: z[1] * z[2])) AS sim FROM pat, (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 3) x), b AS (SELECT pattern, row_number() OVER (ORDER BY sim DESC, pattern) AS rank_without FROM o)
SELECT pattern, rank_with, rank_without FROM a JOIN b USING (pattern) WHERE rank_with <= 10 AND rank_without <= 10""")
def prefix_overlap(spark, d):
    p, top = X.patterns(spark, d), lambda *ids: vector_column(X.vector(spark, d, *ids))
    both = [R.nearest(p, v, 10).select("pattern", F.col("rank").alias(name)) for v, name in ((top(3, 11), "rank_with"), (top(3), "rank_without"))]
    return both[0].join(both[1], "pattern")
