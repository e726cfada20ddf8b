"""Dyadic covers and the range join over them, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dyadic

KEY = lambda r: tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_covers_hold_each_cell_once(spark, bits):
    n = 1 << bits
    spans = [(a, b) for a in range(n) for b in range(a, n)] if bits < 7 else [(a, b) for a in range(0, n, 5) for b in range(a, n, 3)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", dyadic.cover("a", "b", bits).alias("nodes"))
    for r in df.collect():
        cells = sorted(c for x in r.nodes for c in range(x.node << x.level, (x.node + 1) << x.level))
        assert cells == list(range(r.a, r.b + 1)) and len(r.nodes) <= 2 * bits


@pytest.mark.parametrize("bits", [1, 6, 24, 32])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_against_all_pairs(spark, bits, how):
    rng = random.Random(bits)
    inf, nan = math.inf, math.nan
    points = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))])) for i in range(120)]
    points += [(200, None), (201, nan), (202, inf), (203, -inf), (5, points[5][1]), (5, points[5][1])]
    spans = []
    for i in range(50):
        low = rng.uniform(-60, 50)
        spans.append((i, low, low + rng.choice([0.0, 0.001, 1.0, 30.0, 200.0])))
    spans += [(70, 2.0, 2.0), (71, 3.0, 1.0), (72, None, 1.0), (73, 1.0, None), (74, -inf, inf), (75, -1e9, 0.0), (76, 4.0, inf), (70, 2.0, 2.0)]
    a = spark.createDataFrame(points, "_node int, x double").repartition(3)
    b = spark.createDataFrame(spans, "_level int, lo double, hi double").repartition(2)
    got = dyadic.dyadic_join(a, b, "x", "lo", "hi", how, bits)
    assert got.columns == ["_node", "x", "_level", "lo", "hi"]
    want = []
    for p, x in points:
        hits = [s for s, lo, hi in spans if None not in (x, lo, hi) and not math.isnan(x) and lo <= x <= hi]
        want += [(p, s) for s in hits] or ([(p, None)] if how == "left" else [])
    assert sorted((tuple(r) for r in got.select("_node", "_level").collect()), key=KEY) == sorted(want, key=KEY)


def test_one_interval_over_the_whole_domain_is_few_rows(spark):
    for low, high in ((0, (1 << 24) - 1), (1, (1 << 24) - 2), (0, 0)):
        df = spark.createDataFrame([(low, high)], "a long, b long")
        nodes = df.select(F.explode(dyadic.cover("a", "b", 24)).alias("n")).select(F.col("n.level").alias("level"))
        rows = nodes.select(F.sum(F.when(F.col("level") > 24 - dyadic.SALTED_LEVELS, dyadic.SALTS).otherwise(1))).first()[0]
        assert rows <= (64 if low == 0 else 2 * 24 + 2 * dyadic.SALTED_LEVELS * dyadic.SALTS)


def test_empty(spark):
    a, b = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(0.0, 2.0)], "lo double, hi double")
    assert dyadic.dyadic_join(a.limit(0), b, "x", "lo", "hi").collect() == []
    assert dyadic.dyadic_join(a, b.limit(0), "x", "lo", "hi").collect() == []
    assert [tuple(r) for r in dyadic.dyadic_join(a, b.limit(0), "x", "lo", "hi", "left").collect()] == [(1.0, None, None)]
    assert [tuple(r) for r in dyadic.dyadic_join(a, b, "x", "lo", "hi").collect()] == [(1.0, 0.0, 2.0)]
    plan = dyadic.dyadic_join(a, b, "x", "lo", "hi")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_task_makes_most_pairs(spark, monkeypatch):
    """Intervals over the whole domain, which all points are in."""
    from millrace.operators import skew

    monkeypatch.setattr(skew.dealt_join, "__defaults__", (20_000,))
    a, b = spark.range(3000).selectExpr("id as x"), spark.range(200).selectExpr("id as i", "-1 as lo", "3000 as hi")
    made = dyadic.dyadic_join(a, b, "x", "lo", "hi").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 600_000 and max(r["count"] for r in made) <= 150_000
