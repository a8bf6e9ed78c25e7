"""Every registered query of the engine against its SQL."""

from collections import Counter

import duckdb
import pytest

from quadloom import queries, source_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys() >= set(source_queries.NAMES)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == Counter(want.select(*columns).fetchall()) and got
