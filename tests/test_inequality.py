"""Joins on two inequalities against all pairs."""

import math
import operator
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from millrace.operators import inequality

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def key(v):
    return (1, 0.0) if isinstance(v, float) and math.isnan(v) else (0, v)


@pytest.mark.parametrize("op_x", OPS)
@pytest.mark.parametrize("op_y", OPS)
def test_bit_arrays(op_x, op_y):
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (40, 0), (60, 70)):
        lx, rx = rng.integers(0, 20, n).astype(float), rng.integers(0, 20, m).astype(float)
        ly, ry = rng.integers(0, 9, n), rng.integers(0, 9, m)
        lx[::7], rx[::9] = np.nan, np.nan
        got = sorted((i, j) for a, b in inequality.matches(lx, ly, rx, ry, op_x, op_y) for i, j in zip(a.tolist(), b.tolist(), strict=True))
        want = [(i, j) for i in range(n) for j in range(m) if OPS[op_x](key(lx[i]), key(rx[j])) and OPS[op_y](ly[i], ry[j])]
        assert got == want


@pytest.mark.parametrize("block,op_x,op_y", [(5, "<", ">"), (3, ">=", ">="), (None, "<=", "<")])
def test_against_all_pairs(spark, block, op_x, op_y):
    rng = random.Random(7)
    day = datetime(2024, 1, 1)
    none = lambda v: None if rng.random() < 0.1 else v
    value = lambda: none(rng.choice([rng.uniform(0, 5), 2.0, float("nan"), float("inf")]))
    left = [(i, none(day + timedelta(hours=rng.randint(0, 99))), value(), "a") for i in range(60)] + [(0, day, 2.0, "a")] * 2
    right = [(i, none(day + timedelta(hours=rng.randint(0, 99))), value(), None) for i in range(50)] + [(9, day, 2.0, "b")] * 2
    a = spark.createDataFrame(left, "a int, t timestamp_ntz, v double, x string").repartition(3)
    b = spark.createDataFrame(right, "b int, u timestamp_ntz, w double, y string").repartition(2)
    got = inequality.inequality_join(a, b, ("t", op_x, "u"), ("v", op_y, "w"), ["a", "x"], ["b", "u", "y"], block_rows=block)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = [
        (i, x, j, u, y)
        for i, t, v, x in left
        for j, u, w, y in right
        if None not in (t, u, v, w) and OPS[op_x](t, u) and OPS[op_y](key(v), key(w))
    ]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_blocks_that_cannot_meet_do_not(spark):
    """Two bands of rows that satisfy the inequalities at their ends only: few blocks meet."""
    df = spark.range(4000).selectExpr("id as k", "id as x", "id as y")
    other = spark.range(4000).selectExpr("id as j", "id as u", "id + 4 as w")
    got = inequality.inequality_join(df, other, ("x", ">=", "u"), ("y", "<=", "w"), ["k"], ["j"], block_rows=100)
    assert got.count() == sum(1 for k in range(4000) for d in range(5) if k - d >= 0)
    blocks = inequality._blocks(df, df.x, df.y, ["k"], "t", 100)
    assert blocks.count() >= 40 and max(r.x1 - r.x0 for r in blocks.collect()) < 101


def test_kinds_and_empty(spark):
    a = spark.createDataFrame([(1, date(2024, 1, 2), 1 << 60)], "a int, t date, v long")
    b = spark.createDataFrame([(2, date(2024, 1, 3), (1 << 60) + 1)], "b int, u date, w long")
    join = lambda p, q, x, y: inequality.inequality_join(p, q, x, y, ["a"], ["b"]).collect()
    assert [tuple(r) for r in join(a, b, ("t", "<", "u"), ("v", "<", "w"))] == [(1, 2)]
    assert join(a, b, ("t", "<", "u"), ("v", ">=", "w")) == []
    assert join(a.limit(0), b, ("t", "<", "u"), ("v", "<", "w")) == [] == join(a, b.limit(0), ("t", "<", "u"), ("v", "<", "w"))
    with pytest.raises(ValueError):
        join(a, b, ("t", "<", "w"), ("v", "<", "w"))
    with pytest.raises(ValueError):
        join(a, b, ("t", "=", "u"), ("v", "<", "w"))


def test_pairs_of_blocks_are_dealt(spark):
    """All pairs of blocks meet; their rows were made where the left blocks lay."""
    from pyspark.sql import functions as F

    a, b = spark.range(400).selectExpr("id as k", "id as x", "id as y").coalesce(1), spark.range(400).selectExpr("id as j", "id + 500 as u", "id + 500 as w")
    got = inequality.inequality_join(a, b, ("x", "<", "u"), ("y", "<", "w"), ["k"], ["j"], block_rows=50)
    made = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 160_000 and max(r["count"] for r in made) <= 25_000
