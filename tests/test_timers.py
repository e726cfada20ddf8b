"""Top rows by timer: windows appear once they close, late rows count, a restart goes on from the checkpoint."""

from datetime import datetime, timedelta

from millrace.storage import shared_dir
from millrace.streaming import timers, windows

SCHEMA = "k string, ts timestamp, v double, n long"
DAY = datetime(2024, 1, 1)
HOUR = 3_600_000


def write(spark, folder, name, rows):
    rows = [(k, DAY + timedelta(minutes=m), v, n) for k, m, v, n in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, checkpoint, out, initial=None):
    stream = windows.with_event_time(windows.file_stream(spark, "parquet", f"{folder}/*", SCHEMA, files_per_trigger=1), "ts", "10 minutes")
    with windows.rocksdb_state(spark):
        found = timers.windowed_top(stream, "k", "ts", "v", "n", 2, HOUR, initial)
        table = windows.run_to_table(found, "append", checkpoint, out)
    base = int((DAY - datetime(1970, 1, 1)).total_seconds() * 1000)
    return sorted((str(r.k), (r.start_ms - base) // HOUR if r.start_ms >= 0 else -1, r.place, r.n, r.v) for r in table.collect())


def test_windows_close_by_timer_and_a_restart_goes_on(spark, tmp_path):
    folder, checkpoint, out = f"{tmp_path}/in", shared_dir(spark, "c"), f"{tmp_path}/out"
    write(spark, folder, "b0", [("a", 1, 5.0, 1), ("a", 2, 7.0, 2), ("a", 3, 7.0, 3), ("a", 59, 1.0, 4), (None, 5, 2.0, 5), ("b", 61, 4.0, 6)])
    write(spark, folder, "b1", [("a", 65, 9.0, 7), ("a", 66, None, 8), ("a", 67, float("nan"), 9), ("b", 69, 3.0, 10)])
    first = run(spark, folder, checkpoint, out)
    assert first == []  # the watermark is at 59 minutes: nothing has closed
    write(spark, folder, "b2", [("b", 75, 8.0, 11)])
    second = run(spark, folder, checkpoint, out)
    assert second == [("None", 0, 1, 5, 2.0), ("a", 0, 1, 2, 7.0), ("a", 0, 2, 3, 7.0)]
    write(spark, folder, "b3", [("a", 1, 99.0, 12), ("b", 300, 1.0, 13)])  # too late, and far ahead
    third = [r for r in run(spark, folder, checkpoint, out) if r[2]]
    assert third == sorted([*second, ("a", 1, 1, 7, 9.0), ("b", 1, 1, 11, 8.0), ("b", 1, 2, 6, 4.0)])


def test_initial_state(spark, tmp_path):
    folder = f"{tmp_path}/in"
    base = int((DAY - datetime(1970, 1, 1)).total_seconds() * 1000)
    earlier = spark.createDataFrame([("a", base, 6.0, 100), ("a", base, 4.0, 101)], "k string, start long, value double, id long")
    write(spark, folder, "b0", [("a", 10, 5.0, 1), ("z", 200, 1.0, 2)])
    assert run(spark, folder, shared_dir(spark, "c"), f"{tmp_path}/out", earlier) == [("a", 0, 1, 100, 6.0), ("a", 0, 2, 1, 5.0)]
