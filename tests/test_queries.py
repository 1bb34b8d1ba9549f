"""Every query against its SQL, as the driver holds them, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value if value is None or isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = tables.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)


def test_every_query_of_the_engine_has_sql():
    from loamline.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
