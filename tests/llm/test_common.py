"""Helpers that the operators share, against plain Python."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _common, graph


def test_slices_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(_common, "SLICE_BYTES", 1000)
    rows = ["x" * n for n in [1] * 50 + [5000, 5000] + [1] * 20 + [900] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
    parts = list(_common.sliced([batch, batch.slice(0, 0)], rows=16))
    assert [v for p in parts for v in p.column(0).to_pylist()] == rows
    assert all(p.num_rows <= 16 and (p.num_rows == 1 or p.nbytes <= 2000) for p in parts)


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_key_filter_holds_every_key(spark, monkeypatch, bits):
    monkeypatch.setattr(_common, "FILTER_BITS", bits)
    rng = random.Random(1)
    keys = [rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3000)]
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    probes = [(k,) for k in keys] + [(rng.randint(-(1 << 63), (1 << 63) - 1),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(probes, "k long")
    marked = _common.passes(df, "k", _common.key_filter(table, "key", len(keys)), "hit")
    assert "Exchange hashpartitioning(k" not in marked._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.hit for r in marked.collect()}
    assert all(got[k] for k in keys) and got[None] is False
    assert sum(got.values()) < (3000 * 1.2 if bits > 1 << 15 else 3000 * 1.4)
    nobody = _common.passes(df, "k", _common.key_filter(table.limit(0), "key", 0), "hit")
    assert nobody.filter("hit").count() == 0


def test_left_join_few(spark):
    rng = random.Random(2)
    body = [(rng.choice([None, *range(40)]), rng.choice([None, *range(5)]), i) for i in range(300)]
    few = [(None, 1, "n"), (3, None, "m"), (5, 2, "x"), (99, 1, "y")]
    a = spark.createDataFrame(body, "a long, b long, i int")
    b = spark.createDataFrame(few, "p long, q long, v string")
    keyed_a = a.withColumn("ka", F.xxhash64("a", "b"))
    keyed_b = b.withColumn("kb", F.xxhash64("p", "q"))
    out = _common.left_join_few(keyed_a, keyed_b, [("a", "p"), ("b", "q")], "ka", "kb")
    got = Counter((r.a, r.b, r.i, r.v) for r in out.collect())
    index = {(p, q): v for p, q, v in few}
    assert got == Counter((x, y, i, index.get((x, y))) for x, y, i in body)


def test_join_counted(spark):
    rows = [(k, i) for k, n in ((1, 500), (2, 70), (3, 5), (4, 1), (9, 2)) for i in range(n)]
    table = [(1, 500, "a"), (2, 70, "b"), (3, 5, "c"), (4, 1, "d"), (7, 0, "e")]
    a, b = spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame(table, "k int, n long, v string")
    got = Counter((r.k, r.i, r.v) for r in graph.join_counted(a, b, ["k"], len(rows)).collect())
    names = {k: v for k, _, v in table}
    assert got == Counter((k, i, names[k]) for k, i in rows if k in names)


def test_discard(spark):
    df = _common.materialize(spark.range(10), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    _common.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
