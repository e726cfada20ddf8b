"""Queries with SQL, against DuckDB, and results that SQL can't give, against plain sums."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, registry

SF = "/root/testdata/sf0.001"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    relation = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=key)
    assert got == sorted(relation.select(*order).fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(q for q in registry.queries() if q.startswith("op") and not q.startswith("op13")))
def test_one_row_for_every_row(spark, name):
    df = registry.queries()[name](spark, SF).cache()
    source = "pages" if name.startswith("op5") else "documents"
    rows = df.filter("piece = 0") if "piece" in df.columns else df
    assert rows.count() == len(table(source))


def test_mix_is_near_its_targets(spark):
    df = registry.queries()["op7_source_mixing"](spark, SF)
    rows = df.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("t"), F.max("size").alias("m"), F.sum("size").alias("n")).collect()
    goal = mixing.targets({r.source: r.n for r in rows})
    for r in rows:
        assert r.t == goal[r.source] and abs(r.taken - r.t) <= r.m / 2 + 1e-6


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in registry.queries()["op6_quality_classifier"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(scores[d], q) for d, q in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
