"""Windows in two levels, against Spark's own, with one key of half the rows and with peers on both sides of cuts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import longwindows

RANKS = {"rn": ("row_number",), "rk": ("rank",), "dr": ("dense_rank",), "pr": ("percent_rank",), "cd": ("cume_dist",), "t4": ("ntile", 4), "t999": ("ntile", 999)}
OTHERS = {
    "p1": ("lag", "v", 1),
    "p7": ("lag", "v", 7),
    "n2": ("lead", "s", 2),
    "n90": ("lead", "v", 90),
    "total": ("sum", "v"),
    "seen": ("count", "v"),
    "low": ("min", "v"),
    "high": ("max", "s"),
    "head": ("first", "v"),
    "newest": ("last", "v"),
}


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(spark, unique):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        k = "hot" if i % 2 else rng.choice(["a", "b", None, "c"])
        o = i * 7919 % 601 if unique else rng.choice([None, 1, 1, 1, 2, 3])  # a third of the hot key's rows are peers
        rows.append((i, k, o, rng.choice([None, rng.randint(-9, 99)]), rng.choice([None, "x", "y"]), 1))
    rows += [(1000, "alone", None, 5, "z", 1), (1001, "two", 1, None, None, 1), (1002, "two", 2, 3, None, 1)]
    return spark.createDataFrame(rows, "id int, k string, o int, v int, s string, part int").repartition(5)


def spark_columns(functions, w):
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    of = {"first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}
    for name, f in functions.items():
        if f[0] in ("lag", "lead"):
            yield getattr(F, f[0])(f[1], f[2]).over(w).alias(name)
        elif f[0] in longwindows.RUNNING:
            yield of.get(f[0], getattr(F, f[0]))(f[1]).over(frame).alias(name)
        else:
            yield getattr(F, f[0])(*f[1:]).over(w).alias(name)


def rows_of(df):
    return sorted(str([round(x, 12) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_all_functions_in_a_unique_order(spark, small_parts, direction):
    df, functions = table(spark, True), RANKS | OTHERS
    got = longwindows.long_windows(df, ["k"], [("o", direction)], functions)
    order = F.col("o").asc_nulls_first() if direction == "asc" else F.col("o").desc_nulls_last()
    want = df.select("*", *spark_columns(functions, Window.partitionBy("k").orderBy(order)))
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    slices = df.repartitionByRange("k", "o").groupBy(F.spark_partition_id().alias("p"), "k").count()
    assert slices.filter("k = 'hot'").count() >= 3 and slices.agg(F.max("count")).first()[0] < 250


def test_peers_over_cuts(spark, small_parts):
    df = table(spark, False)
    functions = {n: f for n, f in RANKS.items() if f[0] not in ("row_number", "ntile")}
    got = longwindows.long_windows(df, ["k"], [("o", "asc")], functions)
    want = df.select("*", *spark_columns(functions, Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first())))
    assert rows_of(got) == rows_of(want)
    numbers = longwindows.long_windows(df, ["k"], [("o", "asc")], {"rn": ("row_number",), "c": ("count", "id")}).collect()
    for k in {r.k for r in numbers}:
        own = sorted((r for r in numbers if r.k == k), key=lambda r: r.rn)
        assert [r.rn for r in own] == list(range(1, len(own) + 1)) == [r.c for r in own]
        assert all((a.o is not None, a.o or 0) <= (b.o is not None, b.o or 0) for a, b in zip(own, own[1:], strict=False))


def test_without_keys_and_empty(spark, small_parts):
    df = table(spark, True)
    got = longwindows.long_windows(df, [], [("o", "asc"), ("id", "desc")], {"rn": ("row_number",), "p": ("lag", "id", 2)})
    want = df.select("*", *spark_columns({"rn": ("row_number",), "p": ("lag", "id", 2)}, Window.orderBy(F.col("o").asc_nulls_first(), F.desc("id"))))
    assert rows_of(got) == rows_of(want)
    assert longwindows.long_windows(df.limit(0), ["k"], [("o", "asc")], RANKS).collect() == []
    with pytest.raises(ValueError):
        longwindows.long_windows(df, ["k"], [("o", "asc")], {"v": ("rank",)})
    with pytest.raises(ValueError):
        longwindows.long_windows(df, ["k"], [("o", "asc")], {"x": ("median", "v")})
