"""Subqueries by the DataFrame API, lateral joins, further join strategies and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import vectorblocks
from millrace.plans.registry import query
from millrace.session import Tables


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def subquery_scalar(t: Tables) -> DataFrame:
    mean = t.customer.select(F.avg("c_acctbal").alias("mean"))
    return t.customer.filter(F.col("c_acctbal") > mean.scalar()).select("c_custkey")


@query("SELECT s_suppkey, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = s_nationkey) AS top FROM supplier")
def subquery_scalar_correlated(t: Tables) -> DataFrame:
    best = t.customer.filter(F.col("c_nationkey") == F.col("s_nationkey").outer()).select(F.max("c_acctbal"))
    return t.supplier.select("s_suppkey", best.scalar().alias("top"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS "
       "(SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")  # fmt: skip
def subquery_exists(t: Tables) -> DataFrame:
    own = t.orders.filter(F.col("o_custkey") == F.col("c_custkey").outer())
    return t.customer.filter(own.filter("o_totalprice > 400000").exists() & ~own.filter("o_orderstatus = 'P'").exists()).select("c_custkey")


@query("SELECT n_nationkey, top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey)")
def join_lateral(t: Tables) -> DataFrame:
    spark = t.views("nation", "customer")
    return spark.sql("SELECT n_nationkey, top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey)")


@query("SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3)")
def join_lateral_top(t: Tables) -> DataFrame:
    """The three richest customers of each nation, by ``lateralJoin``."""
    own = t.customer.filter(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc("c_acctbal"), "c_custkey").limit(3)
    return t.nation.lateralJoin(own.select("c_custkey")).select("n_nationkey", "c_custkey")


@query("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey <> n_regionkey")
def join_cartesian(t: Tables) -> DataFrame:
    """Two tables of fixed size."""
    rows = t.region.hint("shuffle_replicate_nl").join(t.nation, F.col("r_regionkey") != F.col("n_regionkey"))
    return rows.select("r_regionkey", "n_nationkey")


@query("SELECT query_id, vec_id, place FROM (SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY "
       "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, a.vec_id) AS place "
       "FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE place <= 10")  # fmt: skip
def vector_top_k(t: Tables) -> DataFrame:
    """The ten nearest vectors of every query, by products of matrices. Each block passes on ten a query."""
    scored = vectorblocks.nearest(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 10").select("query_id", "vec_id", "place")


@query("SELECT true AS near, true AS recalled")
def vector_lsh(t: Tables) -> DataFrame:
    """Pairs of queries and vectors closer than 1.15, by random projections: all are that close, and 9 of 10 are found."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    tables = 10
    rows = t.embeddings.filter("embedding is not null").select("vec_id", "embedding", array_to_vector("embedding").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=0.3, numHashTables=tables, seed=7).fit(rows)
    buckets = F.array(*(vector_to_array(F.col("hashes")[i])[0] for i in range(tables)))
    hashed = model.transform(rows).select("vec_id", F.concat(F.col("embedding").cast("array<double>"), buckets).alias("v"))
    seen = vectorblocks.projected(hashed, hashed.filter("vec_id % 100 = 0"), "vec_id", "v", tables, 1.15)
    seen = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "wanted")), F.coalesce(F.bool_and("near"), F.lit(True)).alias("near"))
    return seen.select("near", (10 * F.col("found") >= 9 * F.col("wanted")).alias("recalled"))
