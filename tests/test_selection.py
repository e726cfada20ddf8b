"""Exact quantiles by selection, against Spark's own ``percentile``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import selection

SCHEMA = "g string, x double, y long, slot int, n int, k0 string"


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [("hot", rng.lognormvariate(0, 3), rng.randint(-5, 5)) for _ in range(n)]  # two thirds of all rows
    rows += [(rng.choice(["a", "b", None, "c"]), rng.choice([rng.uniform(-9, 9), 1.0, None]), rng.randint(0, 1 << 40)) for _ in range(n // 2)]
    rows += [("same", 7.0, 7)] * 50 + [("none", None, None)] * 3 + [("one", 1.5, 2)]
    rows += [("odd", v, 1) for v in (float("nan"), float("inf"), float("-inf"), 0.0, float("nan"))]
    return [(g, x, y, 1, 2, "x") for g, x, y in rows]


def same(a, b):
    return a is b or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12)))


@pytest.mark.parametrize("seed,fit,steps", [(1, 40, 32), (3, 100_000, 256)])
def test_equal_to_percentile(spark, seed, fit, steps):
    df = spark.createDataFrame(corpus(seed, 1500), SCHEMA).repartition(5)
    wanted = {"low": ("x", 0.0), "med": ("x", 0.5), "p90": ("x", 0.9), "top": ("x", 1.0), "third": ("y", 1 / 3)}
    trace = []
    got = {r.g: r for r in selection.exact_quantiles(df, ["g"], wanted, fit=fit, steps=steps, trace=trace).collect()}
    finite = df.filter("g is null or g <> 'odd'").groupBy("g").agg(*(F.percentile(c, p).alias(name) for name, (c, p) in wanted.items()))
    want = {r.g: r for r in finite.collect()}
    assert set(got) == {*want, "odd"}
    for g, r in want.items():
        assert all(same(got[g][name], r[name]) for name in wanted), (g, got[g], r)
    odd = got["odd"]
    assert odd.low == -math.inf and odd.med == math.inf and math.isnan(odd.p90) and math.isnan(odd.top)
    assert bool(trace) == (fit < 1000)


def test_rows_of_a_task_stay_bounded(spark):
    """Ten times the rows leave no more to the last task: one round more closes them in."""
    last = []
    for n in (4_000, 40_000):
        df = spark.range(n, numPartitions=6).selectExpr("1 as g", "cast(hash(id) % 1000003 as double) as x")
        trace = []
        (row,) = selection.exact_quantiles(df, ["g"], {"med": ("x", 0.5)}, fit=500, steps=64, trace=trace).collect()
        assert same(row.med, df.agg(F.median("x")).first()[0])
        assert trace[0] < n / 8 and trace == sorted(trace, reverse=True)
        last.append(trace[-1])
    assert max(last) <= 500


def test_many_ties(spark):
    df = spark.range(3000).selectExpr("1 as g", "case when id % 3 = 0 then 5.0 when id % 3 = 1 then 6.0 else 5.0 end as x")
    (row,) = selection.exact_quantiles(df, ["g"], {"med": ("x", 0.5), "p8": ("x", 0.8)}, fit=10, steps=8).collect()
    assert tuple(row) == (1, 5.0, 6.0)


def test_no_keys_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [tuple(r) for r in selection.exact_quantiles(df, [], {"m": ("x", 0.25)}, fit=3, steps=8).collect()] == [(2.5,)]
    empty = df.limit(0)
    assert [tuple(r) for r in selection.exact_quantiles(empty, [], {"m": ("x", 0.25)}).collect()] == [(None,)]
    keyed = spark.createDataFrame([], "g int, x double")
    assert selection.exact_quantiles(keyed, ["g"], {"m": ("x", 0.25)}).collect() == []
    with pytest.raises(ValueError):
        selection.exact_quantiles(df, [], {"m": ("x", 1.5)})
