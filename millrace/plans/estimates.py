"""Samples, sketches and other estimates, each held against the exact value within its stated error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import Tables


def _near(value: Column, exact: Column, share: float) -> Column:
    return F.abs(value - exact) <= share * exact


def _sampled(n: Column, total: Column, share: float) -> Column:
    """Within six standard deviations of a binomial count."""
    return F.abs(n - share * total) <= 6 * F.sqrt(total * share * (1 - share)) + 1


@query("SELECT count(*) AS total, true AS fair FROM lineitem")
def sample_rows(t: Tables) -> DataFrame:
    taken = t.lineitem.sample(fraction=0.1, seed=7).agg(F.count("*").alias("n"))
    return t.lineitem.agg(F.count("*").alias("total")).crossJoin(taken).select("total", _sampled(F.col("n"), F.col("total"), 0.1).alias("fair"))


@query("SELECT count(*) AS total, true AS fair FROM orders")
def sample_table(t: Tables) -> DataFrame:
    t.views("orders")
    taken = t.spark.sql("SELECT count(*) AS n FROM orders TABLESAMPLE (20 PERCENT) REPEATABLE (7)")
    return t.orders.agg(F.count("*").alias("total")).crossJoin(taken).select("total", _sampled(F.col("n"), F.col("total"), 0.2).alias("fair"))


@query("SELECT o_orderstatus, count(*) AS total, true AS fair FROM orders GROUP BY ALL")
def sample_by_key(t: Tables) -> DataFrame:
    """Shares by key; a share of 1 takes all."""
    share = {"F": 0.2, "O": 0.2, "P": 1.0}
    taken = t.orders.sampleBy("o_orderstatus", share, seed=7).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    both = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("total")).join(taken, "o_orderstatus", "left")
    n, total = F.coalesce("n", F.lit(0)), F.col("total")
    fair = F.when(F.col("o_orderstatus") == "P", n == total).otherwise(_sampled(n, total, 0.2))
    return both.select("o_orderstatus", "total", fair.alias("fair"))


@query("SELECT count(DISTINCT l_partkey) AS parts, true AS hll_pp, true AS hll, true AS theta FROM lineitem")
def agg_sketches(t: Tables) -> DataFrame:
    """Distinct counts by sketches, within 5 % of the exact one."""
    # beside a DISTINCT Spark would keep a sketch for each part; equal keys change no sketch, so each side has its own aggregate
    exact = t.lineitem.filter("l_partkey is not null").select("l_partkey").distinct().agg(F.count("*").alias("parts"))
    near = lambda c: _near(F.col(c), F.col("parts"), 0.05).alias(c)
    sketches = t.lineitem.agg(
        F.approx_count_distinct("l_partkey", 0.01).alias("hll_pp"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"),
        F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey", 12)).alias("theta"),
    )
    return exact.crossJoin(sketches).select("parts", near("hll_pp"), near("hll"), near("theta"))  # one row each


@query("SELECT count(DISTINCT l_suppkey) AS supps FROM lineitem")
def agg_theta_exact_below_k(t: Tables) -> DataFrame:
    """A theta sketch of 2^26 places is exact while it holds fewer keys; with more suppliers than that it is an estimate."""
    return t.lineitem.agg(F.theta_sketch_estimate(F.theta_sketch_agg("l_suppkey", 26)).alias("supps"))


@query("SELECT l_returnflag, count(*) AS n, true AS kll, true AS approx FROM lineitem GROUP BY ALL")
def agg_kll_quantiles(t: Tables) -> DataFrame:
    """Medians by estimators: the share of rows up to them is 0.5 within 0.02."""
    est = t.lineitem.groupBy("l_returnflag").agg(
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_extendedprice"), F.lit(0.5)).alias("kll"),
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("approx"),
    )
    rows = t.lineitem.join(F.broadcast(est), "l_returnflag")  # a row for each flag
    share = lambda c: F.abs(F.avg((F.col("l_extendedprice") <= F.col(c)).cast("int")) - 0.5) <= 0.02
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), share("kll").alias("kll"), share("approx").alias("approx"))


@query("SELECT count(*) AS n, true AS within FROM events")
def agg_approx_quantile(t: Tables) -> DataFrame:
    """``approxQuantile`` at an error of 0.01, by the shares of rows up to its three values."""
    found = t.events.approxQuantile("value", [0.25, 0.5, 0.75], 0.01)
    near = None
    for q, x in zip((0.25, 0.5, 0.75), found, strict=False):
        one = F.abs(F.avg((F.col("value") <= x).cast("int")) - q) <= 0.02
        near = one if near is None else near & one
    return t.events.agg(F.count("*").alias("n"), (F.lit(True) if near is None else near).alias("within"))


@query("SELECT count(DISTINCT event_type) FILTER (WHERE 10 * c >= n) AS frequent, true AS found FROM (SELECT event_type, count(*) AS c, sum(count(*)) OVER () AS n FROM events GROUP BY ALL)")
def agg_frequent_items(t: Tables) -> DataFrame:
    """``freqItems`` misses no item with a tenth of the rows."""
    items = t.events.stat.freqItems(["event_type"], 0.1)
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("c"))
    total = t.events.agg(F.count("*").alias("n"))
    often = counts.crossJoin(total).filter("10 * c >= n").agg(F.collect_set("event_type").alias("often"))
    return often.crossJoin(items).select(F.size("often").cast("long").alias("frequent"), (F.size(F.array_except("often", "event_type_freqItems")) == 0).alias("found"))


@query("SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY ALL")
def agg_count_min(t: Tables) -> DataFrame:
    """A count-min sketch never underestimates, and overestimates by 1 % of all rows at most (here with odds of 99 %)."""
    spark = t.spark
    raw, total = t.events.agg(F.count_min_sketch("event_type", F.lit(0.01), F.lit(0.99), F.lit(7)), F.count("*")).first()
    sketch = spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(raw))
    exact = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    kinds = [r.event_type for r in exact.select("event_type").collect()]  # the kinds of events, not the events
    table = spark.createDataFrame([(k, sketch.estimateCount(k)) for k in kinds], "event_type string, estimate long")
    over = F.col("estimate") - F.col("n")
    return exact.join(F.broadcast(table), "event_type").select("event_type", "n", over.between(0, 0.01 * total).alias("within"))


@query("SELECT event_type, count(*) AS n, true AS bounded FROM events GROUP BY ALL")
def agg_histogram_numeric(t: Tables) -> DataFrame:
    """Twelve bins at most, which hold all rows."""
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.histogram_numeric("value", F.lit(12)).alias("h"))
    held = F.aggregate("h", F.lit(0.0), lambda s, b: s + b["y"])
    return rows.select("event_type", "n", ((F.size("h") <= 12) & (F.abs(held - F.col("n")) < 0.5)).alias("bounded"))


@query("SELECT p_brand AS p_brand_size_class, count(*) FILTER (WHERE p_size > 25) AS big, count(*) FILTER (WHERE p_size <= 25) AS small FROM part GROUP BY ALL")
def agg_contingency(t: Tables) -> DataFrame:
    """``crosstab``, whose rows and columns are few: brands and two classes."""
    return t.part.withColumn("size_class", F.when(F.col("p_size") <= 25, "small").otherwise("big")).stat.crosstab("p_brand", "size_class")


@query("SELECT event_type, round(regr_r2(value, CAST(user_id AS DOUBLE)), 9) AS r2, round(regr_intercept(value, CAST(user_id AS DOUBLE)), 5) AS ic, regr_count(value, user_id) AS n "
       "FROM events GROUP BY ALL")  # fmt: skip
def agg_regression(t: Tables) -> DataFrame:
    x = F.col("user_id").cast("double")
    return t.events.groupBy("event_type").agg(
        F.round(F.regr_r2("value", x), 9).alias("r2"), F.round(F.regr_intercept("value", x), 5).alias("ic"), F.regr_count("value", x).alias("n")
    )


@query("SELECT p_brand, string_agg(p_type, '|' ORDER BY p_partkey) AS types, list_sort(list(p_size)) AS sizes FROM part GROUP BY ALL")
def agg_lists(t: Tables) -> DataFrame:
    t.views("part")
    return t.spark.sql("SELECT p_brand, listagg(p_type, '|') WITHIN GROUP (ORDER BY p_partkey) AS types, array_sort(array_agg(p_size)) AS sizes FROM part GROUP BY p_brand")
