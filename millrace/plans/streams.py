"""Streaming queries, run over all that is there; their results are those of the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import Tables
from millrace.storage import shared_dir
from millrace.streaming import timers, windows


def _aggs() -> tuple:
    return F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")


def _events(t: Tables, delay: str = "1 hour") -> DataFrame:
    files = windows.file_stream(t.spark, "parquet", f"{t.folder}/events.parquet", t.events.schema)
    return windows.with_event_time(files, "ts", delay)


def _run(t: Tables, df: DataFrame, mode: str) -> DataFrame:
    return windows.run_to_table(df, mode, shared_dir(t.spark, "stream"), shared_dir(t.spark, "sink"))


def _start(df: DataFrame, window: str = "window") -> DataFrame:
    return df.withColumn("start", F.col(f"{window}.start").cast("timestamp_ntz")).drop(window)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    return _start(_run(t, windows.tumbling(_events(t), "ts", "1 day", ["event_type"], *_aggs()), "complete"))


@query("SELECT d - INTERVAL (k) DAY AS start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT date_trunc('day', ts) AS d, value FROM events), "
       "generate_series(0, 1) g(k) GROUP BY ALL")  # fmt: skip
def stream_sliding(t: Tables) -> DataFrame:
    out = _run(t, windows.sliding(_events(t), "ts", "2 days", "1 day", [], *_aggs()), "complete")
    return _start(out)


@query("""
WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k
""")
def stream_sessions(t: Tables) -> DataFrame:
    out = _run(t, windows.sessions(_events(t), "ts", "30 minutes", ["user_id"], *_aggs()), "complete")
    return _start(out, "session_window")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY ALL")
def stream_state(t: Tables) -> DataFrame:
    updates = _run(t, windows.running_totals(_events(t), "user_id", "value"), "update")
    # every update is there; the last of each key has seen all its rows
    last = updates.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "top"), "n").alias("x"))
    return last.select("user_id", "x.n", F.round("x.total", 2).alias("total"), "x.top")


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """A user seen again after the watermark has passed comes twice, and a null is no user, so they are counted once more."""
    seen = _run(t, windows.distinct_within_watermark(_events(t, "60 days"), ["user_id"]).select("user_id"), "append")
    return seen.agg(F.count_distinct("user_id").alias("users"))


@query("SELECT a.event_id AS buy_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts "
       "WHERE a.event_type = 'purchase' AND b.event_type = 'view'")  # fmt: skip
def stream_stream_join(t: Tables) -> DataFrame:
    buys = _events(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("u"), F.col("ts").alias("buy_ts"))
    views = _events(t).filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"))
    near = (F.col("u") == F.col("user_id")) & F.col("view_ts").between(F.col("buy_ts") - F.expr("INTERVAL 1 HOUR"), F.col("buy_ts"))
    return _run(t, buys.join(views, near).select("buy_id", "view_id"), "append")


@query("SELECT event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL")
def stream_static_join(t: Tables) -> DataFrame:
    joined = _events(t).join(t.customer, F.col("user_id") == F.col("c_custkey"))
    return _run(t, joined.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT event_id, value FROM events")
def stream_foreach_batch(t: Tables) -> DataFrame:
    """Each batch is written under its number: a batch that is seen again replaces itself."""
    out = shared_dir(t.spark, "batches")
    write = lambda batch, k: batch.select("event_id", "value").write.mode("overwrite").parquet(f"{out}/batch={k}")
    windows.run_batches(_events(t), write, shared_dir(t.spark, "stream"))
    return t.spark.read.parquet(out).select("event_id", "value")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase'")
def stream_file_sink(t: Tables) -> DataFrame:
    """Append mode through the file sink, whose log names the files of finished batches only."""
    rows = _events(t).filter("event_type = 'purchase'").select("event_id", "event_type", "value")
    return _run(t, rows, "append")


@query("SELECT * FROM (VALUES (TIMESTAMP '2024-01-01 00:00:00', CAST(1 AS BIGINT)), (TIMESTAMP '2024-01-01 09:00:00', CAST(1 AS BIGINT)), "
       "(TIMESTAMP '2024-01-01 10:00:00', CAST(2 AS BIGINT))) v(start, n)")  # fmt: skip
def stream_late_data(t: Tables) -> DataFrame:
    """Five batches of invented rows, an hour of patience: 09:30 comes late and counts, 00:10 comes too late and is dropped.

    The last batch moves the watermark past all windows but its own.
    """
    folder = shared_dir(t.spark, "late")
    minutes = [[0], [600], [605], [570, 10], [5000]]
    for k, batch in enumerate(minutes):
        rows = t.spark.createDataFrame([(m,) for m in batch], "m int")
        rows.selectExpr("timestamp '2024-01-01' + make_dt_interval(0, 0, m) AS ts").coalesce(1).write.parquet(f"{folder}/b{k}")
    stream = windows.file_stream(t.spark, "parquet", f"{folder}/*", "ts timestamp", files_per_trigger=1)
    out = windows.tumbling(windows.with_event_time(stream, "ts", "1 hour"), "ts", "1 hour", [], F.count("*").alias("n"))
    return _start(_run(t, out, "append"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_transform_with_state(t: Tables) -> DataFrame:
    with windows.rocksdb_state(t.spark):
        updates = _run(t, windows.kept_totals(_events(t), "user_id", "value"), "update")
    return updates.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


@query("""
SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400000 AS start_ms,
       row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS place, event_id, value
FROM events QUALIFY place <= 3 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_top_by_timer(t: Tables) -> DataFrame:
    """The three largest values of each type and day, given out by timers as the days close; the last day stays open."""
    with windows.rocksdb_state(t.spark):
        found = _run(t, timers.windowed_top(_events(t), "event_type", "ts", "value", "event_id", 3, 86_400_000), "append")
    return found.filter("place > 0")
