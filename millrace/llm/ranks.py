"""Numbers 0, 1, 2, .. within groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import materialize


def tagged(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with a unique number ``nr`` that tells the partition it was written from."""
    return materialize(df.withColumn("nr", F.monotonically_increasing_id()), name)


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0, in the order of ``nr``; gapless.

    ``rows`` has been through :func:`tagged`. A row's number is its place among
    those of its group and partition, plus the counts of the partitions before:
    a group is split at its partitions, however large it is. The keys aren't null.
    """
    part = F.shiftrightunsigned("nr", 33).alias("part")
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")
    counts = counts.select(*by, "part", before.alias("before"))
    local = F.row_number().over(Window.partitionBy(*by, "part").orderBy("nr"))
    rows = rows.withColumn("part", part).withColumn("local", local)
    return rows.join(counts, [*by, "part"]).withColumn(name, F.col("before") + F.col("local") - 1).drop("part", "local", "before")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in an order that leaves no ties, by range partitions; the driver sees a count of each."""
    spark = rows.sparkSession
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    table = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("local", local).join(table, "part").withColumn(name, F.col("before") + F.col("local")).drop("part", "local", "before")
