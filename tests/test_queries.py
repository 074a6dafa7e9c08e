"""Every archive query against its SQL on the smallest tables."""

import duckdb
import pytest

from coffer.plans import catalogue

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert rows
    if name in catalogue.ORACLE:
        wanted = duck.sql(catalogue.ORACLE[name])
        assert sorted(wanted.columns) == columns
        order = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(repr(r) for r in wanted.project(order).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
