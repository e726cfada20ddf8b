"""Operators that Spark has no counterpart for, against brute force, with nulls, ties and empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import statistics, text, vectors
from millrace.operators import joins, relational
from millrace.plans import QUERIES
from millrace.session import Tables, get_session
from millrace.sources import files
from millrace.storage import release, shared_dir

KEY = lambda r: tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("width", [None, 4.0, 100.0])
@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, exact, width):
    rng = random.Random(1)
    none = lambda x: None if rng.random() < 0.1 else x
    left = [(i, none(rng.choice("abc")), none(rng.randint(-9, 30))) for i in range(160)]
    right = [(none(rng.choice("abx")), none(rng.randint(-9, 30)), i) for i in range(50)]
    a, b = spark.createDataFrame(left, "id int, k string, ts int"), spark.createDataFrame(right, "k string, ts int, v int")
    got = joins.asof_join(a, b, "ts", ["k"], ["v"], allow_exact=exact, bin_width=width).select("id", "v").collect()
    want = []
    for i, k, ts in left:
        before = [(t, v) for q, t, v in right if None not in (q, t, k, ts) and q == k and (t <= ts if exact else t < ts)]
        want.append((i, max(before)[1] if before else None))
    assert sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)
    assert joins.asof_join(a, b.limit(0), "ts", ["k"], ["v"]).filter("v is not null").count() == 0
    assert joins.asof_join(a.limit(0), b, "ts", ["k"], ["v"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_range(spark, how, width):
    rng = random.Random(2)
    points = [(i, rng.uniform(-20, 20)) for i in range(80)] + [(99, None)]
    spans = [(i, lo := rng.uniform(-20, 20), lo + rng.uniform(0, 8)) for i in range(30)] + [(77, None, 1.0)]
    a, b = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, lo double, hi double")
    got = joins.range_join(a, b, "x", "lo", "hi", width, how).select("p", "s").collect()
    want = []
    for p, x in points:
        hits = [s for s, lo, hi in spans if None not in (x, lo) and lo <= x <= hi]
        want += [(p, s) for s in hits] or ([(p, None)] if how == "left" else [])
    assert sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)


def test_asof_names_that_clash(spark):
    a = spark.createDataFrame([(1, 5, 0)], "_left int, ts int, _bin int")
    b = spark.createDataFrame([(1, 3, 9)], "_left int, ts int, _right int")
    for width in (None, 2.0):
        assert [tuple(r) for r in joins.asof_join(a, b, "ts", ["_left"], ["_right"], bin_width=width).collect()] == [(1, 5, 0, 9)]


@pytest.mark.parametrize("width", [60.0, 3600.0, 1e6])
def test_interval(spark, width):
    rng = random.Random(4)
    day = datetime(2024, 1, 1)
    make = lambda n: [(i, rng.choice(["a", "b", None]), day + timedelta(minutes=rng.randint(0, 400)) if rng.random() < 0.9 else None) for i in range(n)]
    left, right = make(50), make(60)
    a, b = (spark.createDataFrame(x, "i int, k string, ts timestamp") for x in (left, right))
    got = joins.interval_join(a, b, ["k"], "ts", "ts", "20 minutes", "1 hour", width).select(F.col("a.i"), F.col("b.i")).collect()
    want = [(i, j) for i, k, s in left for j, q, u in right if None not in (k, q, s, u) and k == q and s - timedelta(minutes=20) <= u <= s + timedelta(hours=1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_alike_rows_are_salted_apart(spark):
    a = spark.createDataFrame([("hot", 1)] * 400, "k string, n int").repartition(8)
    b = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert joins.salted_join(a, b, ["k"], 4).count() == 400


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted(spark, how):
    a = spark.createDataFrame([(1, "hot", i) for i in range(50)] + [(2, "x", 0), (3, None, 0)], "i int, k string, n int")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("y", 3)], "k string, v int")
    got = joins.salted_join(a, b, ["k"], 5, how).select("i", "k", "n", "v").collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(map(tuple, a.join(b, "k", how).select("i", "k", "n", "v").collect()), key=KEY)


def test_sessions_and_latest(spark):
    day = datetime(2024, 1, 1)
    rows = [("a", day + timedelta(minutes=m), m) for m in (0, 10, 45, 46, 120)] + [("b", day, 1)]
    df = spark.createDataFrame(rows, "u string, ts timestamp, v int")
    got = {(r.u, r.v): r.session for r in relational.sessionize(df, ["u"], "ts", "30 minutes").collect()}
    assert got == {("a", 0): 0, ("a", 10): 0, ("a", 45): 1, ("a", 46): 1, ("a", 120): 2, ("b", 1): 0}
    assert {tuple(r) for r in relational.latest_per_key(df, ["u"], "ts", ["v"]).collect()} == {("a", 120), ("b", 1)}
    assert relational.top_k_per_group(df, ["u"], [F.desc("v")], 2).count() == 3


def test_statistics_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = df.agg(statistics.sample_skewness("x").alias("s"), statistics.sample_excess_kurtosis("x").alias("k")).first()
    assert r.s is None and r.k is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.dot(a, b).alias("d"), F.round(vectors.cosine(a, b), 9).alias("c"), vectors.l2_distance(a, b).alias("l")).collect()
    assert [tuple(r) for r in got] == [(10.0, 1.0, 5.0**0.5), (0.0, None, 2.0**0.5), (None, None, None)]


def test_text(spark):
    df = spark.createDataFrame([(" A\t\nb ",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(text.normalize_space(F.col("t")), text.word_count(F.col("t"))).collect()]
    assert got == [("A b", 2), ("", 0), (None, 0)]


def test_formats_need_a_schema(spark):
    for fmt in ("csv", "json", "xml"):
        with pytest.raises(ValueError):
            files.read(spark, fmt, "/nowhere")
    with pytest.raises(ValueError):
        files.read(spark, "nothing", "/nowhere")


def test_plans_push_down(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.lineitem.filter("l_quantity < 5").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    plan = joins.range_join(t.part, t.part.selectExpr("p_size - 1 as lo", "p_size + 1.0 as hi"), "p_retailprice", "lo", "hi", 10.0)
    text_ = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text_ and "Cartesian" not in text_
    asof = joins.asof_join(t.events, t.events.selectExpr("user_id", "ts", "value as v"), "ts", ["user_id"], ["v"])
    assert asof._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert get_session().conf.get("spark.sql.adaptive.enabled") == "true"


def test_shared_dir_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "local-cluster[2,1,1024]"
        applicationId = "x"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError):
        shared_dir(Session(), "x")


def test_release(spark, tmp_path):
    path = shared_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    release(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


PLANS = {
    "join_sort_merge": "SortMergeJoin",
    "join_shuffle_hash": "ShuffledHashJoin",
    "join_broadcast_hash": "BroadcastHashJoin",
    "join_nested_loop": "BroadcastNestedLoopJoin",
    "join_cartesian": "CartesianProduct",
    "top_k_per_user": "WindowGroupLimit",
    "vector_top_k": "WindowGroupLimit",
    "sort_limit_offset": "TakeOrderedAndProject",
    "shipping_priority": "TakeOrderedAndProject",
    "subquery_exists": "LeftAnti",
    "join_semi": "LeftSemi",
    "join_anti": "LeftAnti",
    "udf_arrow": "ArrowEvalPython",
}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_strategy(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert PLANS[name] in plan
    if name not in ("join_nested_loop", "join_cartesian", "vector_top_k"):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("pricing_summary", "agg_statistics", "agg_min_max", "latest_event"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Aggregate(") >= 2


def test_scans_read_few_columns(spark):
    plan = QUERIES["pricing_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_orderkey" not in plan and "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan


def test_udf_on_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "abc")], "p_partkey long, p_name string")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, QUERIES["udf_scalar"](spark, str(tmp_path)).collect())) == [(1, None), (2, 3)]


def test_groups_and_exclude_with_nulls(spark):
    rng = random.Random(6)
    none = lambda x: None if rng.random() < 0.2 else x
    rows = [(i, rng.choice("ab"), none(rng.randint(0, 5)), none(rng.randint(1, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, k string, o int, v int")
    out = relational.groups_frame(df, F.sum, "v", "near", ["k"], "o", -1, 1)
    for kind in ("row", "group", "ties"):
        out = relational.sum_excluding(out, "v", kind, ["k"], "o", kind)
    total = lambda values: sum(values) if (values := [v for v in values if v is not None]) else None
    for r in out.collect():
        own = [x for x in rows if x[1] == r.k]
        order = sorted({x[2] for x in own}, key=lambda o: (o is not None, o))
        near = order[max(0, order.index(r.o) - 1) : order.index(r.o) + 2]
        assert r.near == total(x[3] for x in own if x[2] in near)
        assert r.row == total(x[3] for x in own if x[0] != r.i)
        assert r.group == total(x[3] for x in own if x[2] != r.o)
        assert r.ties == total(x[3] for x in own if x[2] != r.o or x[0] == r.i)
    with pytest.raises(ValueError):
        relational.sum_excluding(df, "v", "x", ["k"], "o", "all")


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("width", [60.0, 600.0, 3600.0, 86_400.0])
@pytest.mark.parametrize("day", [datetime(2024, 3, 10), datetime(2024, 11, 3)], ids=["spring", "autumn"])
def test_local_times_where_clocks_change(spark, new_york, width, day):
    """Times without a zone are compared by the clock that they show, whatever the session's zone skips or repeats."""
    rng = random.Random(11)
    left = [(i, "k", day + timedelta(minutes=rng.randint(0, 300))) for i in range(60)]
    right = [("k", day + timedelta(minutes=rng.randint(0, 300)), i) for i in range(40)]
    left.append((99, "k", day.replace(hour=2, minute=30)))
    right.append(("k", day.replace(hour=3, minute=10), 99))
    a = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    b = spark.createDataFrame(right, "k string, ts timestamp_ntz, v int")
    pairs = joins.interval_join(a, b, ["k"], "ts", "ts", "0 hours", "1 hour", bin_seconds=width).select("id", "v").collect()
    want = [(i, v) for i, _, t in left for _, u, v in right if t <= u <= t + timedelta(hours=1)]
    assert sorted(map(tuple, pairs)) == sorted(want) and (99, 99) in want
    got = {r.id: r.v for r in joins.asof_join(a, b, "ts", ["k"], ["v"], bin_width=width).collect()}
    for i, _, t in left:
        before = [(u, v) for _, u, v in right if u <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_sum_excluding_what_is_not_a_number(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (2, 1, 5.0), (3, 2, 1e17), (4, 2, 0.5)], "id int, o int, v double")
    got = {r.id: r.s for r in relational.sum_excluding(df.filter("id < 3"), "v", "s", [], "o", "row").collect()}
    assert got[1] == 5.0 and got[2] != got[2]
    rest = {r.id: r.s for r in relational.sum_excluding(df.filter("id > 1"), "v", "s", [], "o", "row").collect()}
    assert rest[3] == 5.5


def test_urls_of_all_pages(spark, tmp_path):
    urls = ["http://a.com/x?q=1", "no url", None, "http://a b/", "https://c.org"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["scalar_urls"](spark, str(tmp_path)).collect()}
    assert got[0] == ("http", "a.com", "/x", "q=1") and got[1] == got[2] == got[3] == (None,) * 4 and got[4][:2] == ("https", "c.org")
