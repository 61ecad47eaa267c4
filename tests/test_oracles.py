"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from millrace import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    wanted = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    at = {c: i for i, c in enumerate(wanted.columns)}
    theirs = sorted((tuple(plain(r[at[c]]) for c in columns) for r in wanted.fetchall()), key=repr)
    assert mine == theirs


def test_queries_without_sql(spark):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert registry.FLAGSHIP in __spark_entry__.queries()
