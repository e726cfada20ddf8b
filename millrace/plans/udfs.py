"""The user-defined functions, by kind."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import Tables


@query("SELECT p_partkey, p_retailprice * 1.1 AS price FROM part")
def udf_pandas(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def dearer(x: pd.Series) -> pd.Series:
        return x * 1.1

    return t.part.select("p_partkey", dearer("p_retailprice").alias("price"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def udf_arrow(t: Tables) -> DataFrame:
    @F.arrow_udf("string")
    def upper(x: pa.Array) -> pa.Array:
        return pc.utf8_upper(x)

    return t.part.select("p_partkey", upper("p_name").alias("name"))


@query("SELECT p_partkey, length(p_name) % 7 AS m FROM part")
def udf_scalar(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.udf(lambda s: None if s is None else len(s) % 7, "long", useArrow=True)("p_name").alias("m"))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY ALL")
def udf_aggregate(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return math.fsum(x) / len(x)  # whatever the order of the rows

    return t.part.groupBy("p_brand").agg(mean("p_retailprice").alias("mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT n_nationkey, i AS part FROM nation, generate_series(0, 24) g(i) WHERE i < n_regionkey")
def udf_table(t: Tables) -> DataFrame:
    @F.udtf(returnType="part: long")
    class Parts:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    t.spark.udtf.register("parts", Parts)
    t.views("nation")
    return t.spark.sql("SELECT n_nationkey, part FROM nation, LATERAL parts(n_regionkey)")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 300000")
def udf_map_arrow(t: Tables) -> DataFrame:
    def dear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pc.greater(batch.column("o_totalprice"), 300_000))
            yield pa.RecordBatch.from_arrays([rows.column("o_orderkey"), pc.multiply(rows.column("o_totalprice"), 2.0)], names=["o_orderkey", "twice"])

    return t.orders.select("o_orderkey", "o_totalprice").mapInArrow(dear, "o_orderkey long, twice double")


@query("SELECT i AS part FROM generate_series(0, 24) g(i)")
def udf_table_arrow(t: Tables) -> DataFrame:
    """On arguments of its own: Spark has no lateral join with a table function in Arrow."""

    @F.arrow_udtf(returnType="part: long")
    class ArrowParts:
        def eval(self, n: pa.Array) -> Iterator[pa.Table]:
            for k in n.to_pylist():
                yield pa.table({"part": pa.array(range(k), pa.int64())})

    return ArrowParts(F.lit(25))


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place FROM supplier")
def udf_grouped_map(t: Tables) -> DataFrame:
    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_suppkey": frame.s_suppkey, "place": frame.s_acctbal.rank(ascending=False, method="min").astype("int64")})

    return t.supplier.groupBy("s_nationkey").applyInPandas(rank, "s_suppkey long, place long")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def udf_map_batches(t: Tables) -> DataFrame:
    def dear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[batch.o_totalprice > 300_000]

    return t.orders.select("o_orderkey", "o_totalprice").mapInPandas(dear, "o_orderkey long, o_totalprice double")


@query("SELECT n_nationkey AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, "
       "(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")  # fmt: skip
def udf_cogroup(t: Tables) -> DataFrame:
    def count(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a, b = t.customer.select("c_nationkey", "c_custkey"), t.supplier.select("s_nationkey", "s_suppkey")
    return a.groupBy("c_nationkey").cogroup(b.groupBy("s_nationkey")).applyInPandas(count, "nation int, customers long, suppliers long")
