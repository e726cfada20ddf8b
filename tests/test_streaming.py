"""Late data, micro-batches and state over constructed input."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans import QUERIES

from millrace.storage import shared_dir
from millrace.streaming import windows

SCHEMA = "k string, ts timestamp, v double"
DAY = datetime(2024, 1, 1)


def batches(spark, folder, groups):
    """One file a batch, in order."""
    for i, rows in enumerate(groups):
        spark.createDataFrame([(k, DAY + timedelta(minutes=m), float(v)) for k, m, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")


def stream(spark, folder, delay="1 hour"):
    return windows.with_event_time(windows.file_stream(spark, "parquet", f"{folder}/*", SCHEMA, files_per_trigger=1), "ts", delay)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches(spark, folder, [[("a", 0, 1)], [("a", 600, 1)], [("a", 605, 1)], [("a", 570, 1), ("a", 10, 1)], [("a", 5000, 1)]])
    out = windows.run_to_table(windows.tumbling(stream(spark, folder), "ts", "1 hour", ["k"], F.count("*").alias("n")), "append", shared_dir(spark, "t"), f"{tmp_path}/out")
    got = {int((r.window.start - DAY).total_seconds() // 60): r.n for r in out.collect()}
    assert got[540] == 1 and got[600] == 2  # 570 is within the hour; 10 is late and its window closed
    assert got[0] == 1


def test_state_over_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches(spark, folder, [[("a", 0, 1), ("b", 1, 5)], [("a", 2, 3)], [("b", 3, 2), ("b", 4, 9)]])
    out = windows.run_to_table(windows.running_totals(stream(spark, folder), "k", "v"), "update", shared_dir(spark, "t"), f"{tmp_path}/out")
    last = {}
    for r in out.collect():
        last[r.k] = max(last.get(r.k, (0,)), (r.n, r.total, r.top))
    assert last == {"a": (2, 4.0, 3.0), "b": (3, 16.0, 9.0)}


def test_a_batch_seen_again_replaces_itself(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    batches(spark, folder, [[("a", 0, 1)], [("b", 1, 2)]])
    write = lambda batch, k: [batch.write.mode("overwrite").parquet(f"{sink}/batch={k}") for _ in range(2)]
    windows.run_batches(stream(spark, folder), write, shared_dir(spark, "t"))
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == ["a", "b"]


def test_tables_that_are_folders(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").repartition(2).write.parquet(f"{tmp_path}/customer.parquet")
    key = lambda rows: sorted(str([round(v, 3) if isinstance(v, float) else v for v in r]) for r in rows)
    for name in ("stream_dedup", "stream_tumbling", "stream_static_join", "stream_file_sink"):
        whole, parts = (QUERIES[name](spark, d).collect() for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert whole and key(whole) == key(parts)


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        windows.file_stream(spark, "parquet", str(tmp_path), SCHEMA)


def test_complete_mode_returns_the_last_batch(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches(spark, folder, [[("a", 0, 1)], [("a", 1, 1), ("b", 2, 1)]])
    counts = stream(spark, folder).groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, windows.run_to_table(counts, "complete", shared_dir(spark, "t"), f"{tmp_path}/out").collect())) == [("a", 2), ("b", 1)]


def test_idle_state_is_dropped(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches(spark, folder, [[("a", 0, 1)], [("a", 5, 1), ("b", 600, 1)], [("b", 601, 1)], [("a", 700, 3)], [("b", 702, 1)]])
    for ts, n in (("ts", 1), (None, 3)):
        rows = windows.running_totals(stream(spark, folder), "k", "v", ts, 600_000)
        out = windows.run_to_table(rows, "update", shared_dir(spark, "t"), f"{tmp_path}/out{n}").collect()
        assert [r.n for r in out if r.k == "a" and r.top == 3] == [n] and max(r.n for r in out if r.k == "b") == 3


def test_console_sink(spark, tmp_path):
    batches(spark, f"{tmp_path}/in", [[("a", 0, 1)]])
    windows.run_to_console(stream(spark, f"{tmp_path}/in"), "append", shared_dir(spark, "t"))


def test_what_a_stream_cannot_do(spark, tmp_path):
    batches(spark, f"{tmp_path}/in", [[("a", 0, 1)]])
    rows = stream(spark, f"{tmp_path}/in")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    for bad in (rows.orderBy("v"), numbered):
        with pytest.raises(AnalysisException):
            windows.run_to_table(bad, "append", shared_dir(spark, "t"), f"{tmp_path}/bad")


def test_null_values_and_null_keys(spark, tmp_path):
    """A key with null values only has no sum; NaN comes back as null; a null key is no user."""
    rows = [("a", None), ("a", None), ("b", 1.0), ("b", None), ("c", float("nan")), ("c", 2.0), (None, 3.0)]
    spark.createDataFrame(rows, "k string, v double").repartition(1).write.parquet(f"{tmp_path}/in")
    source = windows.file_stream(spark, "parquet", f"{tmp_path}/in", "k string, v double")
    out = windows.run_to_table(windows.running_totals(source, "k", "v"), "update", shared_dir(spark, "n"), f"{tmp_path}/out")
    got = {r.k: (r.n, str(r.total), str(r.top)) for r in out.collect()}
    assert got == {"a": (2, "None", "None"), "b": (2, "1.0", "1.0"), "c": (2, "None", "None"), None: (1, "3.0", "3.0")}
    with windows.rocksdb_state(spark):
        out = windows.run_to_table(windows.kept_totals(source, "k", "v"), "update", shared_dir(spark, "n"), f"{tmp_path}/out2")
        assert {r.k: (r.n, str(r.total)) for r in out.collect()} == {k: v[:2] for k, v in got.items()}
