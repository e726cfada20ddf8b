"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

import __spark_entry__
from millrace import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.QUERIES, plans.ORACLE_SQL  # the training-data operators are tested by themselves


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([str([value(r[i]) for i in order]) for r in data])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got and df.columns
        return
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, got) == rows(relation.columns, relation.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
