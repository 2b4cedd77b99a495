"""Every query that has SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lamella.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(round(r[k], 6) if isinstance(r[k], float) and math.isfinite(r[k]) else r[k] for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalogue.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
