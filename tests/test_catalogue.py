"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import math

import pytest

from evidentia.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return int(x) if x.is_integer() else x
    return x if isinstance(x, (int, str)) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    cursor = duck.sql(SQL[name])
    assert sorted(cursor.columns) == names
    at = [cursor.columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).schema is not None


def test_flagship_has_a_packet_per_question(spark):
    rows = flagship(spark, SF).collect()
    assert rows and all(r.used_chars <= 6000 for r in rows)
