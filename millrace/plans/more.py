"""Join strategies, sampling, sketches, and further scalar families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import frames, relational
from millrace.plans.registry import query
from millrace.session import Tables

_JOINED = "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"


def _joined(t: Tables, hint: str) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus").hint(hint).join(t.lineitem.select("l_orderkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(_JOINED)
def join_sort_merge(t: Tables) -> DataFrame:
    return _joined(t, "merge")


@query(_JOINED)
def join_shuffle_hash(t: Tables) -> DataFrame:
    return _joined(t, "shuffle_hash")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_broadcast_hash(t: Tables) -> DataFrame:
    nations = F.broadcast(t.nation)  # 25 rows, whatever the scale
    return t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT a.r_name AS a, b.n_name AS b FROM region a JOIN nation b ON a.r_regionkey < b.n_regionkey")
def join_nested_loop(t: Tables) -> DataFrame:
    """Two tables of fixed size; for others see ``operators.joins.range_join``."""
    rows = t.region.join(F.broadcast(t.nation), F.col("r_regionkey") < F.col("n_regionkey"))
    return rows.select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part)")
def stack_columns(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", "stack(2, 'size', cast(p_size as double), 'price', p_retailprice) as (name, value)")


@query("SELECT n_nationkey, x AS a, x * x AS b FROM nation, generate_series(1, 3) g(x)")
def inline_structs(t: Tables) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")), lambda x: F.struct(x.alias("a"), (x * x).alias("b")))
    return t.nation.select("n_nationkey", F.inline(pairs))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS p "
       "FROM orders WHERE nullif(o_custkey % 5, 0) IS NOT NULL")  # fmt: skip
def fill_drop_replace(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"), F.col("o_orderpriority").alias("p"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k"))
    return rows.dropna(subset=["k"]).fillna("none", subset=["s"]).replace("1-URGENT", "urgent", subset=["p"]).select("o_orderkey", "s", "p")


@query("SELECT p_brand, min(p_partkey) AS any_id, max(p_size) AS top FROM part GROUP BY ALL")
def agg_min_max(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("any_id"), F.max("p_size").alias("top"))


@query("SELECT l_linestatus, l_returnflag AS mode FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) "
       "QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_returnflag) = 1")  # fmt: skip
def agg_mode(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(F.mode("l_returnflag", True).alias("mode"))  # of ties the lowest


@query("SELECT n_regionkey, r_name FROM (SELECT DISTINCT n_regionkey FROM nation) JOIN region ON n_regionkey = r_regionkey")
def agg_any_value(t: Tables) -> DataFrame:
    """All rows of a group agree, so any of them is the same."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_regionkey").agg(F.any_value("r_name").alias("r_name"))


@query("SELECT list_sort(list(DISTINCT p_type)) AS types, list_sort(list(DISTINCT p_brand)) AS brands FROM part")
def agg_collect_set(t: Tables) -> DataFrame:
    return t.part.agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set("p_brand")).alias("brands"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def sort_within_partitions(t: Tables) -> DataFrame:
    """Rows laid out by brand and sorted in each partition: the window needs no further shuffle or sort."""
    laid = t.part.repartition("p_brand").sortWithinPartitions("p_brand", F.desc("p_retailprice"), "p_partkey")
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return laid.select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS near, "
       "count(p_size) OVER (PARTITION BY p_brand ORDER BY p_type GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ahead FROM part")  # fmt: skip
def window_groups(t: Tables) -> DataFrame:
    """GROUPS frames, which Spark's SQL lacks, by the numbers of the groups."""
    rows = relational.groups_frame(t.part, F.sum, "p_size", "near", ["p_brand"], "p_type", -1, 0)
    return relational.groups_frame(rows, F.count, "p_size", "ahead", ["p_brand"], "p_type", 1, 2).select("p_partkey", "near", "ahead")


@query(", ".join(
    ["SELECT p_partkey"]
    + [f"sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {what})::BIGINT AS {name}"
       for what, name in (("CURRENT ROW", "others"), ("GROUP", "apart"), ("TIES", "alone"))]
) + " FROM part")
def window_exclude(t: Tables) -> DataFrame:
    """EXCLUDE, which Spark's SQL lacks, for sums over a whole key."""
    kinds = (("others", "current row"), ("apart", "group"), ("alone", "ties"))
    rows = frames.all_frame_aggregates(t.part, ["p_brand"], "p_type", [({name: ("sum", "p_size")}, None, None, kind) for name, kind in kinds])
    return rows.select("p_partkey", "others", "apart", "alone")


@query("SELECT p_partkey, ascii(p_brand) AS a, base64(encode(p_brand)) AS b, lower(hex(p_brand)) AS h, ltrim(' ' || p_type) AS l, rpad(p_brand, 12, '.') AS r, "
       "url_encode(p_name) AS u, strlen(p_name) AS o FROM part")  # fmt: skip
def scalar_encodings(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.ascii("p_brand").alias("a"),
        F.base64(F.col("p_brand").cast("binary")).alias("b"),
        F.lower(F.hex("p_brand")).alias("h"),
        F.ltrim(F.concat(F.lit(" "), "p_type")).alias("l"),
        F.rpad("p_brand", 12, ".").alias("r"),
        F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")).alias("u"),
        F.octet_length("p_name").cast("long").alias("o"),
    )


@query("SELECT p_partkey, list_sort(list_distinct([p_size % 3, p_size % 5, 1])) AS d, list_reverse([1, 2, p_size]) AS r, [p_size, 2] || [3] AS c, "
       "list_position([7, p_size], p_size) AS i, len(flatten([[1], [p_size, 2]])) AS f FROM part")  # fmt: skip
def scalar_array_shapes(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select(
        "p_partkey",
        F.array_sort(F.array_distinct(F.array(n % 3, n % 5, F.lit(1)))).alias("d"),
        F.reverse(F.array(F.lit(1), F.lit(2), n)).alias("r"),
        F.concat(F.array(n, F.lit(2)), F.array(F.lit(3))).alias("c"),
        F.array_position(F.array(F.lit(7), n), n).cast("int").alias("i"),
        F.size(F.flatten(F.array(F.array(F.lit(1)), F.array(n, F.lit(2))))).cast("long").alias("f"),
    )


@query("SELECT p_partkey, map_keys(m) AS k, map_values(m) AS v, m['size'] AS s FROM (SELECT p_partkey, MAP {'size': p_size, 'len': CAST(length(p_name) AS INTEGER)} AS m FROM part)")
def scalar_maps(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size"), F.lit("len"), F.length("p_name"))
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", F.map_keys("m").alias("k"), F.map_values("m").alias("v"), F.col("m")["size"].alias("s"))


@query("SELECT p_partkey, to_json({'a': p_size, 'b': p_brand}) AS j, json_array_length('[' || p_size || ', 2]') AS n FROM part")
def scalar_json_write(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))).alias("j"),
        F.json_array_length(F.concat(F.lit("["), "p_size", F.lit(", 2]"))).cast("long").alias("n"),
    )


@query("SELECT event_id, epoch_us(ts) AS us, make_date(2024, 1, 1 + CAST(event_id % 28 AS INTEGER)) AS md, CAST(ts + INTERVAL 1 MONTH AS DATE) AS nm FROM events")
def scalar_intervals(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.make_date(F.lit(2024), F.lit(1), (1 + F.col("event_id") % 28).cast("int")).alias("md"),
        F.add_months(F.to_date("ts"), 1).alias("nm"),
    )
