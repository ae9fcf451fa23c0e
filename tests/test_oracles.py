"""Every registered brand query against its SQL twin, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from brandweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    return sorted(tuple(sorted((k, repr(v)) for k, v in zip(columns, r, strict=True))) for r in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(names, result.fetchall())


def test_contract(spark):
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
