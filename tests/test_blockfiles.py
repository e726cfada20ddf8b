"""Block files: round trips, splits, pushed filters, commits, aborts and streams."""

import io
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.sources import blockfiles
from millrace.storage import shared_dir

SF = "/root/testdata/sf0.001"


def test_splits_read_each_block_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(k * 10, k * 10 + 10)), "s": [blockfiles.MARK.hex() * k] * 10}) for k in range(20)]
    fake = pa.RecordBatch.from_pydict({"x": [1000], "b": [blockfiles.MARK * 3]})  # data that hold the mark
    data = b"".join(map(blockfiles.pack, batches)) + blockfiles.pack(fake)
    for step in (1, 97, 1000, len(data)):
        found = []
        for low in range(0, len(data), step):
            found += [x for b in blockfiles.blocks_of(io.BytesIO(data), low, low + step, len(data), []) for x in b.column("x").to_pylist()]
        assert found == [*range(200), 1000]
    wanted = [("x", ">=", 50), ("x", "<", 60), ("nothing", "=", 1)]
    assert [b.column("x")[0].as_py() for b in blockfiles.blocks_of(io.BytesIO(data), 0, len(data), len(data), wanted)] == [50]
    damaged = bytearray(data)
    damaged[len(blockfiles.pack(batches[0])) - 5] ^= 1
    with pytest.raises(blockfiles.DamagedBlock):  # behind a sound block a damaged one is an error, not a gap
        second = blockfiles.pack(batches[1]) + bytes(damaged[: len(blockfiles.pack(batches[0]))])
        list(blockfiles.blocks_of(io.BytesIO(second), 0, len(second), len(second), []))


def test_round_trip_filters_and_overwrite(spark, tmp_path):
    blockfiles.register(spark)
    path = f"{tmp_path}/t"
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.orderBy("o_orderkey").coalesce(2).write.format("blocks").option("block_rows", 100).mode("append").save(path)
    back = spark.read.format("blocks").option("split_bytes", 2000).load(path)
    assert back.schema == orders.schema and sorted(back.collect()) == sorted(orders.collect()) and back.rdd.getNumPartitions() > 4
    where = [("o_orderkey", ">=", 700), ("o_orderkey", "<", 720), ("o_orderstatus", "in", ["F", "O"])]
    some = blockfiles.read(spark, path, where)
    assert sorted(some.collect()) == sorted(orders.filter("o_orderkey >= 700 and o_orderkey < 720 and o_orderstatus in ('F', 'O')").collect())
    assert back.filter("o_orderkey < 10").count() == orders.filter("o_orderkey < 10").count() and back.count() == orders.count()
    reader = blockfiles.BlockReader(path, orders.schema, 1 << 30, where)
    reader = blockfiles.BlockReader(path, orders.schema, 1 << 30, where)
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert 20 <= read <= 300  # blocks of a hundred rows that may hold them, of 1500
    orders.limit(3).write.format("blocks").mode("append").save(path)
    assert back.count() == orders.count() + 3
    orders.limit(5).write.format("blocks").mode("overwrite").save(path)
    assert spark.read.format("blocks").load(path).count() == 5


def test_aborted_write_leaves_nothing(spark, tmp_path):
    blockfiles.register(spark)
    path = f"{tmp_path}/t"
    spark.range(10).write.format("blocks").mode("append").save(path)
    bad = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") == 77, F.raise_error("stop").cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("blocks").mode("append").save(path)
    assert spark.read.format("blocks").load(path).count() == 10
    assert len(os.listdir(f"{path}/data")) <= 10 and os.listdir(f"{path}/_commits") == ["000000000000.json"]
    assert [f for f in os.listdir(f"{path}/_staged") if not f.endswith(".json")] == []


def test_stream_of_commits(spark, tmp_path):
    blockfiles.register(spark)
    path, sink, checkpoint = f"{tmp_path}/t", f"{tmp_path}/out", shared_dir(spark, "c")
    run = lambda: (
        spark.readStream.format("blocks").schema("id long, v string").load(path).writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "cast(id as string) as v").write.format("blocks").mode("append").save(path)
    rows(0, 50)
    run()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(50))
    rows(50, 80)
    rows(80, 90)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(90))


def test_empty_and_nulls(spark, tmp_path):
    blockfiles.register(spark)
    df = spark.createDataFrame([(None, None, float("nan")), (1, "ü", None), (None, "", 2.0)], "i int, s string, d double")
    df.write.format("blocks").mode("append").save(f"{tmp_path}/n")
    back = spark.read.format("blocks").load(f"{tmp_path}/n")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.filter("d > 100").count() == 1
    df.limit(0).write.format("blocks").mode("append").save(f"{tmp_path}/e")
    assert spark.read.format("blocks").load(f"{tmp_path}/e").collect() == []
    with pytest.raises(Exception, match="schema"):
        spark.read.format("blocks").load(f"{tmp_path}/nothing").collect()
