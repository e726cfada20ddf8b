"""Where engines differ in meaning, and constructed nulls, NaN and rows out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans.registry import query
from millrace.session import Tables

_ROWS = "(3, 'c', CAST('NaN' AS DOUBLE)), (1, 'a', CAST(2.5 AS DOUBLE)), (4, NULL, CAST(-1.5 AS DOUBLE)), (2, 'b', NULL), (5, 'a', CAST('NaN' AS DOUBLE)), (NULL, 'b', CAST(0 AS DOUBLE))"


def _rows(t: Tables) -> DataFrame:
    """Rows out of order, with nulls in every column and NaN."""
    return t.spark.sql(f"SELECT * FROM VALUES {_ROWS} AS v(id, k, x)")


@query(f"SELECT id, k, row_number() OVER (ORDER BY id NULLS FIRST) AS up, row_number() OVER (ORDER BY id DESC NULLS LAST) AS down FROM (VALUES {_ROWS}) v(id, k, x)")
def null_order(t: Tables) -> DataFrame:
    """Nulls come first in ascending order, last in descending order. (One window over six rows.)"""
    up, down = (F.row_number().over(Window.orderBy(o)).cast("long") for o in (F.col("id"), F.desc("id")))
    return _rows(t).select("id", "k", up.alias("up"), down.alias("down"))


@query(f"SELECT k, count(*) AS n, count(x) AS xs, max(x) AS top, min(x) AS low, count(DISTINCT x) AS kinds FROM (VALUES {_ROWS}) v(id, k, x) GROUP BY k")
def nan_and_null_groups(t: Tables) -> DataFrame:
    """Nulls are a group; NaN equals itself and is the largest number."""
    return _rows(t).groupBy("k").agg(
        F.count("*").alias("n"), F.count("x").alias("xs"), F.max("x").alias("top"), F.min("x").alias("low"), F.count_distinct("x").alias("kinds")
    )


@query(f"WITH v AS (SELECT * FROM (VALUES {_ROWS}) v(id, k, x)) SELECT id, lag(id) OVER (PARTITION BY k ORDER BY id NULLS FIRST) AS before FROM v")
def rows_out_of_order(t: Tables) -> DataFrame:
    return _rows(t).select("id", F.lag("id").over(Window.partitionBy("k").orderBy("id")).alias("before"))


@query(f"WITH v AS (SELECT * FROM (VALUES {_ROWS}) v(id, k, x)) SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.k IS NOT DISTINCT FROM b.k WHERE a.id < b.id")
def null_safe_join(t: Tables) -> DataFrame:
    a, b = _rows(t).select(F.col("id").alias("a"), F.col("k").alias("p")), _rows(t).select(F.col("id").alias("b"), F.col("k").alias("q"))
    return a.join(b, F.col("p").eqNullSafe(F.col("q")) & (F.col("a") < F.col("b"))).select("a", "b")


@query("SELECT * FROM (VALUES (1, 10), (2, NULL), (3, NULL), (4, 10), (5, NULL)) v(id, prior)")
def asof_with_nulls(t: Tables) -> DataFrame:
    """Null keys and null times match nothing, on either side."""
    left = t.spark.sql("SELECT * FROM VALUES (1, 'a', 5), (2, CAST(NULL AS STRING), 5), (3, 'a', CAST(NULL AS INT)), (4, 'a', 3), (5, 'a', 2) AS v(id, k, ts)")
    right = t.spark.sql("SELECT * FROM VALUES ('a', 3, 10), ('a', CAST(NULL AS INT), 11), (CAST(NULL AS STRING), 4, 12), ('b', 1, 13) AS v(k, ts, prior)")
    return joins.asof_join(left, right, "ts", ["k"], ["prior"], bin_width=2.0).select("id", "prior")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_extendedprice) AS INTEGER) AS i, CAST(trunc(-l_extendedprice) AS INTEGER) AS j FROM lineitem")
def cast_truncates(t: Tables) -> DataFrame:
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return t.lineitem.select(*keys, F.col("l_extendedprice").cast("int").alias("i"), (-F.col("l_extendedprice")).cast("int").alias("j"))


@query("SELECT c_custkey, round(ln(c_custkey), 9) AS natural, CASE WHEN c_custkey % 3 > 0 THEN 'a' || c_name END AS joined, "
       "CASE WHEN c_custkey % 3 > 0 THEN 'a-' || c_name ELSE 'a' END AS joined_ws, substr(c_name, 1, 2) AS zero, substr(c_name, -3) AS tail FROM customer WHERE c_custkey > 0")  # fmt: skip
def meaning_of_functions(t: Tables) -> DataFrame:
    """``log`` is natural, ``concat`` of a null is null, and position 0 counts as 1."""
    name = F.when(F.col("c_custkey") % 3 > 0, F.col("c_name"))
    return t.customer.filter("c_custkey > 0").select(
        "c_custkey",
        F.round(F.log("c_custkey"), 9).alias("natural"),
        F.concat(F.lit("a"), name).alias("joined"),
        F.concat_ws("-", F.lit("a"), name).alias("joined_ws"),
        F.substring("c_name", 0, 2).alias("zero"),
        F.substring("c_name", -3, 3).alias("tail"),
    )


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total, 'bigint' AS kind, round(CAST(sum(CAST(p_retailprice AS DECIMAL(15, 2)) * CAST(1.05 AS DECIMAL(15, 2))) AS DOUBLE), 4) AS price, "
       "'decimal(31,4)' AS product FROM part GROUP BY p_brand")  # fmt: skip
def types_of_results(t: Tables) -> DataFrame:
    """A sum of int is bigint; a product of decimal(15,2) is decimal(31,4)."""
    product = F.col("p_retailprice").cast("decimal(15,2)") * F.lit("1.05").cast("decimal(15,2)")
    rows = t.part.withColumn("product", product)
    return rows.groupBy("p_brand").agg(
        F.sum("p_size").alias("total"),
        F.typeof(F.sum("p_size")).alias("kind"),
        F.round(F.sum("product").cast("double"), 4).alias("price"),
        F.first(F.typeof("product")).alias("product"),
    )
