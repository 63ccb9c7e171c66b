"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from quernstone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(norm(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
