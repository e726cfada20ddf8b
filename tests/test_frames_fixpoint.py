"""GROUPS frames with EXCLUDE against DuckDB, and recursion against a search by hand."""

import math
import random
from collections import Counter

import duckdb
import pytest

from millrace.operators import fixpoint, frames

BOUNDS = {(None, None): "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", (-2, 1): "2 PRECEDING AND 1 FOLLOWING", (1, 2): "1 FOLLOWING AND 2 FOLLOWING", (None, -1): "UNBOUNDED PRECEDING AND 1 PRECEDING", (0, 0): "CURRENT ROW AND CURRENT ROW"}


@pytest.mark.parametrize("bounds", BOUNDS, ids=str)
@pytest.mark.parametrize("exclude", frames.KINDS)
def test_frames_against_duckdb(spark, bounds, exclude):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float(rng.randint(-9, 9)), 1e17, float("nan"), float("inf"), 0.1])
    rows = [(i, rng.choice(["a", None]), rng.choice([None, 1, 2, 2, 3, 4]), value() if i % 3 else float(i)) for i in range(70)]
    df = spark.createDataFrame(rows, "_row int, k string, o int, v double").repartition(3)
    functions = {f"{f}_v": (f, "v") for f in ("min", "max", "count")}
    got = frames.frame_aggregates(df, ["k"], "o", functions, *bounds, exclude)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (_row INT, k VARCHAR, o INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    columns = ", ".join(f"{f}(v) OVER w AS {n}" for n, (f, _) in functions.items())
    want = con.execute(f"SELECT *, {columns} FROM t WINDOW w AS (PARTITION BY k ORDER BY o NULLS FIRST GROUPS BETWEEN {BOUNDS[bounds]} EXCLUDE {exclude})").fetchall()
    assert got.columns == ["_row", "k", "o", "v", *functions]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("exclude", frames.KINDS)
def test_sums_of_what_is_left(spark, exclude):
    rows = [(1, 1, 5.0), (2, 1, float("nan")), (3, 2, float("inf")), (4, 3, 1e17), (5, 3, 0.25), (6, 4, None)]
    df = spark.createDataFrame(rows, "id int, o int, v double")
    got = frames.frame_aggregates(df, [], "o", {"s": ("sum", "v"), "m": ("avg", "v")}, -1, 0, exclude).collect()
    for r in got:
        own = [x for x in rows if r.o - 1 <= x[1] <= r.o]
        if exclude == "current row":
            own = [x for x in own if x[0] != r.id]
        elif exclude == "group":
            own = [x for x in own if x[1] != r.o]
        elif exclude == "ties":
            own = [x for x in own if x[1] != r.o or x[0] == r.id]
        values = [x[2] for x in own if x[2] is not None]
        if not values:
            assert r.s is None and r.m is None
        else:
            total = sum(values)
            assert (math.isnan(total) and math.isnan(r.s) and math.isnan(r.m)) or (r.s == total and r.m == total / len(values))


def test_frames_refuse_what_they_cannot_do(spark):
    df = spark.createDataFrame([(1, 1.0)], "o int, v double")
    for bad in (dict(exclude="some"), dict(low=2, high=1)):
        with pytest.raises(ValueError):
            frames.frame_aggregates(df, [], "o", {"s": ("sum", "v")}, **bad)
    with pytest.raises(ValueError):
        frames.frame_aggregates(df, [], "o", {"s": ("median", "v")})
    assert frames.frame_aggregates(df.limit(0), [], "o", {"s": ("sum", "v")}).collect() == []


@pytest.mark.parametrize("gather", [2, 8])
def test_reachable(spark, monkeypatch, gather):
    monkeypatch.setattr(fixpoint, "GATHER", gather)
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(100, 101), (101, 102), (102, 100), (None, 1), (3, None), (7, 7)]
    edges += edges[:5]
    origins = [0, 3, 100, 999, None, 0]
    df = spark.createDataFrame(edges, "a int, b int")
    got = fixpoint.reachable(df, spark.createDataFrame([(o,) for o in origins], "o int"), "a", "b", "o").collect()
    want = Counter()
    for o in {x for x in origins if x is not None}:
        hops, frontier = {o: 0}, [o]
        while frontier:
            new = {b for a, b in edges if a in frontier and b is not None} - set(hops)
            hops |= dict.fromkeys(new, max(hops.values()) + 1)
            frontier = list(new)
        want += Counter((o, n, h) if h else (o, n, 0) for n, h in hops.items())
    assert Counter(map(tuple, got)) == want


def test_rows_found_twice_and_bounds(spark):
    seed = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "k int, v string")
    step = lambda found: found.selectExpr("k + 1 as k", "v || '.' as v").filter("k < 6 or k is null")
    got = {(r.k, r.v, r.round) for r in fixpoint.fixpoint(seed, step, ["k"]).collect()}
    assert got == {(1, "a", 0), (None, "n", 0), *((k, "a" + "." * (k - 1), k - 1) for k in range(2, 6))}
    assert {r.k for r in fixpoint.fixpoint(seed, step, ["k"], rounds=2).collect()} == {None, 1, 2, 3}
    assert fixpoint.fixpoint(seed.limit(0), step, ["k"]).collect() == []
