"""Structured Streaming: windows, deduplication, joins and state, as functions of a streaming or batch DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.operators.joins import free_name


def file_stream(spark: SparkSession, fmt: str, path: str, schema: StructType | str, files_per_trigger: int = 1000, **options) -> DataFrame:
    """A stream of the files at ``path``: a file, a folder of part files, or a pattern. It is an error if there is none."""
    found = spark.read.format(fmt).schema(schema).options(**options).load(path).inputFiles()
    if not found:
        raise FileNotFoundError(f"no files for a stream at {path}")
    if [f.rsplit("/", 1)[-1] for f in found] == [path.rsplit("/", 1)[-1]]:
        path = f"{path[:-1]}[{path[-1]}]"  # a single file: streams take folders and patterns only
    return spark.readStream.format(fmt).schema(schema).options(maxFilesPerTrigger=files_per_trigger, **options).load(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark on ``ts``, which becomes a timestamp with the session's time zone: others can't carry one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggs) -> DataFrame:
    return df.groupBy(F.window(ts, size), *keys).agg(*aggs)


def sliding(df: DataFrame, ts: str, size: str, step: str, keys: list[str], *aggs) -> DataFrame:
    return df.groupBy(F.window(ts, size, step), *keys).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def distinct_within_watermark(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def _grown(total: float | None, top: float | None, values: pd.Series) -> tuple[float | None, float | None]:
    """A sum and a largest value with more values, none of them null; NaN is the largest."""
    if not len(values):
        return total, top
    added, most = float(values.sum(skipna=False)), float("nan") if values.isna().any() else float(values.max())
    if total is None:
        return added, most
    return total + added, top if math.isnan(top) or not (math.isnan(most) or most > top) else most


def running_totals(df: DataFrame, key: str, value: str, ts: str | None = None, idle_ms: int = 0) -> DataFrame:
    """Rows, sum and largest value of each key so far, one row for each key that a batch touches.

    Null values count as rows only; a key with no other has a null sum and no largest value.
    A NaN among the values makes both null: pandas hands NaN back as null.

    With ``ts``, the column of the watermark, the state of a key is dropped
    once the watermark is ``idle_ms`` past its latest row: state stays bounded.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, top = state.get if state.exists else (0, None, None)
        latest = 0
        for frame in frames:
            if ts:
                latest = max(latest, int(frame[ts].max().timestamp() * 1000))
            n, total, top = n + len(frame), *_grown(total, top, frame.loc[frame[has], value])
        state.update((n, total, top))
        if ts:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + max(1, idle_ms))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total], "top": [top]})

    has = free_name("_has", df)  # pandas can't tell a null from NaN
    df = df.withColumn(has, F.col(value).isNotNull())
    kind = df.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, n long, total double, top double", "n long, total double, top double", "update", timeout
    )


class _Totals(StatefulProcessor):
    """Rows and sum of each key so far, as a value in the state store; dropped after ``ttl_ms`` without a row, if that is set."""

    def __init__(self, key: str, value: str, has: str, ttl_ms: int | None):
        self.key, self.value, self.has, self.ttl_ms = key, value, has, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, None)
        for frame in rows:
            n, total = n + len(frame), _grown(total, None if total is None else 0.0, frame.loc[frame[self.has] == 1, self.value])[0]
        self.state.update((n, total))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def kept_totals(df: DataFrame, key: str, value: str, ttl_ms: int | None = None) -> DataFrame:
    """As :func:`running_totals`, by ``transformWithState``, whose state can expire by itself. Needs :func:`rocksdb_state`."""
    has = free_name("has_", df)
    df = df.select(key, value, F.when(F.col(value).isNotNull(), 1).otherwise(0).alias(has))
    kind = df.schema[key].dataType.simpleString()
    mode = "ProcessingTime" if ttl_ms else "None"
    return df.groupBy(key).transformWithStateInPandas(_Totals(key, value, has, ttl_ms), f"{key} {kind}, n long, total double", "Update", mode)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB, on the executors' disks, instead of their heaps."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_table(df: DataFrame, mode: str, checkpoint: str, path: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet files at ``path``; returns what it gave.

    Append mode goes through the file sink. In complete and update mode each
    batch is a folder of its own, so that a batch that is seen again replaces
    itself; complete mode returns the last one, update mode all updates.
    Nothing is kept in the driver.
    """
    spark = df.sparkSession
    if mode == "append":
        _run(df.writeStream.format("parquet").option("path", path).outputMode(mode), checkpoint)
        return spark.read.schema(df.schema).parquet(path)
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    _run(df.writeStream.foreachBatch(write).outputMode(mode), checkpoint)
    if not numbers:
        return spark.createDataFrame([], df.schema)
    folder = f"{path}/batch={max(numbers)}" if mode == "complete" else f"{path}/batch=*"
    return spark.read.schema(df.schema).parquet(folder)


def run_to_console(df: DataFrame, mode: str, checkpoint: str, rows: int = 20) -> None:
    """Show what a stream over all that is there now gives, batch by batch (to look at, in development)."""
    _run(df.writeStream.format("console").option("numRows", rows).outputMode(mode), checkpoint)


def run_batches(df: DataFrame, function, checkpoint: str) -> None:
    """Run a stream over all that is there now, batch by batch; ``function(batch, number)`` may see a batch again after a failure."""
    _run(df.writeStream.foreachBatch(function), checkpoint)
