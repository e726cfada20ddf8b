"""Projection, filters, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.functions.statistics import sample_excess_kurtosis, sample_skewness
from millrace.operators import joins, relational, skew
from millrace.plans.registry import query
from millrace.session import Tables



def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n_rows
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(t: Tables) -> DataFrame:
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(revenue()), 2).alias("sum_disc"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count("*").alias("n_rows"),
        )
    )


@query("""
SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10
""")
def shipping_priority(t: Tables) -> DataFrame:
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    return (
        t.customer.filter("c_mktsegment = 'BUILDING'")
        .join(t.orders.filter(F.col("o_orderdate") < day), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.lineitem.filter(F.col("l_shipdate") > day), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", "o_orderdate")
        .agg(F.round(F.sum(revenue()), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderkey")
        .limit(10)
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL
""")
def local_supplier_volume(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name")
        .agg(F.round(F.sum(revenue()), 2).alias("revenue"))
    )


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity FROM lineitem "
       "WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_discount < 0.03")  # fmt: skip
def project_filter(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & (F.col("l_discount") < 0.03))
    return rows.select("l_orderkey", "l_linenumber", F.round(revenue(), 4).alias("net"), "l_quantity")


@query("SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class "
       "FROM part WHERE p_name LIKE '%e%'")  # fmt: skip
def case_like(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return t.part.filter(F.col("p_name").like("%e%")).select("p_partkey", "p_name", size.alias("size_class"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS filled FROM customer")
def null_handling(t: Tables) -> DataFrame:
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.select("c_custkey", seg.alias("seg"), F.coalesce(seg, F.lit("-")).alias("filled"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, "
       "count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY ALL")  # fmt: skip
def pivot_status(t: Tables) -> DataFrame:
    wide = relational.pivot(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("SELECT s_suppkey, name, value FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nation FROM supplier) "
       "UNPIVOT (value FOR name IN (s_acctbal, s_nation))")  # fmt: skip
def unpivot_supplier(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nation"))
    return relational.unpivot(rows, ["s_suppkey"], ["s_acctbal", "s_nation"])


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) "
       "WHERE word <> '' GROUP BY ALL HAVING count(*) >= 5")  # fmt: skip
def explode_words(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).filter("n >= 5")


@query("SELECT vec_id, i - 1 AS pos, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def posexplode_vector(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


@query("WITH RECURSIVE c(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 12) SELECT n, f FROM c")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql(
        "WITH RECURSIVE c(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 12) SELECT n, f FROM c"
    )


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) v(id, name)")
def inline_values(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, NULL) AS v(id, name)")


# ---------------------------------------------------------------- joins


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_totalprice > 400000")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT a.s_suppkey AS a_key, b.c_custkey AS b_key FROM (SELECT * FROM supplier WHERE s_nationkey < 5) a FULL JOIN "
       "(SELECT * FROM customer WHERE c_nationkey > 3) b ON s_nationkey = c_nationkey")  # fmt: skip
def join_full(t: Tables) -> DataFrame:
    a = t.supplier.filter("s_nationkey < 5").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("a_key"))
    b = t.customer.filter("c_nationkey > 3").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("b_key"))
    return skew.full_join(a, b, ["nation"]).select("a_key", "b_key")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.region.select(F.col("r_name").alias("b")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(t: Tables) -> DataFrame:
    orders = t.orders.filter("o_orderstatus = 'P'")
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal - 9000")
def join_theta(t: Tables) -> DataFrame:
    on = (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_acctbal") < F.col("c_acctbal") - 9000)
    return t.supplier.join(t.customer, on).select("s_suppkey", "c_custkey")


@query("SELECT p_partkey, k AS band FROM part JOIN (SELECT CAST(i AS BIGINT) AS k, 900 + 37.5 * i AS lo, 960 + 37.5 * i AS hi "
       "FROM generate_series(0, 30) g(i)) b ON p_retailprice BETWEEN lo AND hi")  # fmt: skip
def join_range(t: Tables) -> DataFrame:
    bands = t.spark.range(31).select(F.col("id").alias("band"), (900 + 37.5 * F.col("id")).alias("lo"), (960 + 37.5 * F.col("id")).alias("hi"))
    return joins.range_join(t.part, bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id "
       "AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR AND a.event_id <> b.event_id WHERE a.event_type = 'purchase'")  # fmt: skip
def join_interval(t: Tables) -> DataFrame:
    out = joins.interval_join(t.events.filter("event_type = 'purchase'"), t.events, ["user_id"], "ts", "ts", "0 hours", "1 hour")
    return out.filter("a.event_id <> b.event_id").select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


@query("""
SELECT a.event_id, b.event_id AS prior_id, b.value AS prior_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') b
ON a.user_id = b.user_id AND a.ts >= b.ts
""")
def join_asof(t: Tables) -> DataFrame:
    right = t.events.filter("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("prior_id"), F.col("value").alias("prior_value"))
    return joins.asof_join(t.events.filter("event_type = 'purchase'"), right, "ts", ["user_id"], ["prior_id", "prior_value"], bin_width=86_400.0).select(
        "event_id", "prior_id", "prior_value"
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity > "
       "(SELECT 1.5 * avg(l_quantity) FROM lineitem m WHERE m.l_partkey = l.l_partkey)")  # fmt: skip
def subquery_correlated(t: Tables) -> DataFrame:
    mean = t.lineitem.groupBy("l_partkey").agg((1.5 * F.avg("l_quantity")).alias("limit_qty"))
    return t.lineitem.join(mean, "l_partkey").filter("l_quantity > limit_qty").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def subquery_scalar_not_in(t: Tables) -> DataFrame:
    spark = t.views("customer", "nation")
    return spark.sql(
        "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) "
        "AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_salted(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return joins.salted_join(t.orders.select("o_custkey", "o_orderstatus", "o_orderkey"), customers, ["o_custkey"], 4).groupBy("o_orderstatus").agg(
        F.count("*").alias("n")
    )


# ---------------------------------------------------------------- aggregates


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, "
       "count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem")  # fmt: skip
def agg_distinct_filter(t: Tables) -> DataFrame:
    return t.lineitem.agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("supps"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.count_if(F.col("l_discount") > 0.05).alias("cheap"),
    )


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL HAVING count(*) > 12")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 12")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return t.part.groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n")).select("p_brand", "p_type", "n")


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c, "
       "round(covar_samp(value, user_id), 4) AS cv, round(regr_slope(value, user_id), 8) AS slope FROM events GROUP BY ALL")  # fmt: skip
def agg_statistics(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("double")
    return t.events.withColumn("user_id", user).groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"),
        F.round(F.var_pop("value"), 6).alias("vp"),
        F.round(F.corr("value", "user_id"), 6).alias("c"),
        F.round(F.covar_samp("value", "user_id"), 4).alias("cv"),
        F.round(F.regr_slope("value", "user_id"), 8).alias("slope"),
    )


@query("SELECT round(skewness(value), 6) AS sk, round(kurtosis(value), 6) AS ku FROM events")
def agg_moments(t: Tables) -> DataFrame:
    return t.events.agg(F.round(sample_skewness("value"), 6).alias("sk"), F.round(sample_excess_kurtosis("value"), 6).alias("ku"))


@query("SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY ALL")
def agg_quantiles(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_quantity").alias("med"), F.percentile("l_extendedprice", 0.9).alias("p90"))


@query("SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) AS ids, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY ALL")
def agg_collect(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"), F.array_sort(F.collect_set("lang")).alias("langs")
    )


@query("SELECT user_id, arg_max(event_id, ts) AS last_id, arg_min(event_id, ts) AS first_id FROM events GROUP BY ALL")
def agg_arg(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("last_id"), F.min_by("event_id", "ts").alias("first_id"))


@query("SELECT l_returnflag, bool_and(l_quantity > 0) AS all_pos, bool_or(l_discount = 0) AS any_free, bit_or(l_linenumber) AS bo, "
       "bit_and(l_linenumber) AS ba, bit_xor(l_linenumber) AS bx FROM lineitem GROUP BY ALL")  # fmt: skip
def agg_bool_bit(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.bool_and(F.col("l_quantity") > 0).alias("all_pos"),
        F.bool_or(F.col("l_discount") == 0).alias("any_free"),
        F.bit_or("l_linenumber").alias("bo"),
        F.bit_and("l_linenumber").alias("ba"),
        F.bit_xor("l_linenumber").alias("bx"),
    )


@query("SELECT CAST(least(greatest(floor(value / 25), -1), 20) + 1 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def agg_histogram(t: Tables) -> DataFrame:
    return relational.histogram(t.events, "value", 0.0, 500.0, 20)


@query("SELECT p_brand, count(*) FILTER (WHERE p_size <= 25) AS small, count(*) FILTER (WHERE p_size > 25) AS big FROM part GROUP BY ALL")
def agg_crosstab(t: Tables) -> DataFrame:
    table = t.part.withColumn("size_class", F.when(F.col("p_size") <= 25, "small").otherwise("big"))
    return relational.pivot(table, ["p_brand"], "size_class", ["small", "big"], F.count(F.lit(1))).na.fill(0)


# ---------------------------------------------------------------- windows


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts")


@query("SELECT event_id, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, "
       "round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")  # fmt: skip
def window_ranks(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.row_number().over(by_user()).cast("long").alias("rn"),
        F.rank().over(by_user()).cast("long").alias("rk"),
        F.dense_rank().over(by_user()).cast("long").alias("dr"),
        F.round(F.percent_rank().over(by_user()), 9).alias("pr"),
        F.round(F.cume_dist().over(by_user()), 9).alias("cd"),
        F.ntile(4).over(by_user()).cast("long").alias("q"),
    )


@query("SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, first_value(value) OVER w AS head, nth_value(value, 2) OVER w AS second "
       "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")  # fmt: skip
def window_offsets(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.lag("value").over(by_user()).alias("prev"),
        F.lead("value", 2).over(by_user()).alias("next2"),
        F.first("value").over(by_user()).alias("head"),
        F.nth_value("value", 2).over(by_user()).alias("second"),
    )


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, "
       "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events")  # fmt: skip
def window_frames(t: Tables) -> DataFrame:
    spark = t.views("events")
    return spark.sql(
        "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, "
        "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events"
    )


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS last_buy FROM events")
def window_ignore_nulls(t: Tables) -> DataFrame:
    buy = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.select("event_id", F.last(buy, ignorenulls=True).over(by_user()).alias("last_buy"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def top_k_per_user(t: Tables) -> DataFrame:
    return relational.top_k_per_group(t.events, ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "value")


@query("SELECT event_id, CAST(sum(CASE WHEN prev IS NOT NULL AND ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session "
       "FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)")  # fmt: skip
def window_sessions(t: Tables) -> DataFrame:
    return relational.sessionize(t.events, ["user_id"], "ts", "6 hours").select("event_id", F.col("session").cast("long").alias("session"))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def latest_event(t: Tables) -> DataFrame:
    return relational.latest_per_key(t.events, ["user_id"], "ts", ["event_type", "value"])


# ---------------------------------------------------------------- sorting and sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def sort_limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(t: Tables) -> DataFrame:
    # the right side keeps a row a key before they meet: Spark would join all its rows
    rich = t.supplier.filter("s_acctbal > 5000").select("s_nationkey").distinct()
    return t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(rich)


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT p_size AS k FROM part EXCEPT SELECT CAST(l_quantity AS INTEGER) FROM lineitem WHERE l_quantity < 40")
def set_except(t: Tables) -> DataFrame:
    # the right side keeps a row a key before they meet, as in set_intersect
    few = t.lineitem.filter("l_quantity < 40").select(F.col("l_quantity").cast("int")).distinct()
    return t.part.select(F.col("p_size").alias("k")).subtract(few)


@query("SELECT p_size AS k FROM part EXCEPT ALL SELECT p_size FROM part WHERE p_brand = 'Brand#11'")
def set_except_all(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("k")).exceptAll(t.part.filter("p_brand = 'Brand#11'").select("p_size"))


@query("SELECT n_name AS name, CAST(n_nationkey AS INTEGER) AS key FROM nation UNION ALL BY NAME SELECT r_regionkey AS key, r_name AS name FROM region")
def set_union_by_name(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return a.unionByName(t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def distinct_texts(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
