"""Every source and sink: rows are written, read back and compared with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import Tables
from millrace.sources import blockfiles, files, generator
from millrace.storage import shared_dir
from millrace.streaming import windows

ALL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _round_trip(t: Tables, fmt: str, write: dict | None = None, read: dict | None = None) -> DataFrame:
    path = shared_dir(t.spark, fmt)
    files.write(t.nation, fmt, path, **(write or {}))
    return files.read(t.spark, fmt, path, t.nation.schema, **(read or {})).select(*t.nation.columns)


@query(ALL)
def source_parquet(t: Tables) -> DataFrame:
    return _round_trip(t, "parquet", {"partition_by": ["n_regionkey"]})


@query(ALL)
def source_orc(t: Tables) -> DataFrame:
    return _round_trip(t, "orc")


@query(ALL)
def source_csv(t: Tables) -> DataFrame:
    return _round_trip(t, "csv", {"header": True}, {"header": True})


@query(ALL)
def source_json(t: Tables) -> DataFrame:
    return _round_trip(t, "json")


@query(ALL)
def source_xml(t: Tables) -> DataFrame:
    return _round_trip(t, "xml", {"rowTag": "nation", "rootTag": "nations"}, {"rowTag": "nation"})


@query("SELECT n_name AS value FROM nation")
def source_text(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "text")
    files.write(t.nation.select(F.col("n_name").alias("value")), "text", path)
    return files.read(t.spark, "text", path)


@query("SELECT CAST(25 AS BIGINT) AS lines")
def source_binary_files(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "binary")
    files.write(t.nation.select("n_name"), "text", path)
    raw = files.read(t.spark, "binaryFile", path, pathGlobFilter="*.txt")
    return raw.agg(F.sum(F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))).alias("lines"))


@query("SELECT i AS id, 'row' || i AS name FROM generate_series(0, 99) g(i)")
def source_custom(t: Tables) -> DataFrame:
    generator.register(t.spark)
    return t.spark.read.format("numbered").option("rows", 100).option("slices", 3).load()


@query(ALL)
def source_arrow(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(t.nation.toArrow())  # 25 rows, whatever the scale


@query(ALL)
def source_pandas(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(t.nation.toPandas(), t.nation.schema)  # 25 rows, whatever the scale


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_totalprice > 250000")
def source_blocks(t: Tables) -> DataFrame:
    """Orders in block files: written in order, read again by blocks whose bounds may hold what is wanted."""
    path = shared_dir(t.spark, "blocks")
    blockfiles.register(t.spark)
    t.orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.format("blocks").mode("append").save(path)
    where = [("o_orderkey", ">=", 100), ("o_orderkey", "<=", 900), ("o_totalprice", ">", 250000)]
    return blockfiles.read(t.spark, path, where).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def stream_blocks(t: Tables) -> DataFrame:
    """Orders streamed from block files: two commits, and what a second run finds new is added to the first's."""
    path, checkpoint, sink = (shared_dir(t.spark, n) for n in ("blocks", "stream", "sink"))
    blockfiles.register(t.spark)
    columns = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        columns.filter(part).write.format("blocks").mode("append").save(path)
        stream = t.spark.readStream.format("blocks").schema(columns.schema).load(path)
        out = windows.run_to_table(stream, "append", checkpoint, sink)
    return out
