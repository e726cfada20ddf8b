"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import release, shared_dir

#: The words of several operators: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows are handed back to Spark once about this many bytes are waiting.
FLUSH_BYTES = 8 << 20
#: Rows, and bytes of Arrow data, that are Python objects at a time (one row may have more).
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            release(df.sparkSession, path)


def store(uri: str):
    """The file system and the path of a place in the shared folder, as executors open it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def text_bytes(values: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    return [v or b"" for v in values.to_pylist()]


def texts(values: pa.Array) -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return [v or "" for v in values.to_pylist()]


_CACHES: list[Callable[[], None]] = []
_serving: list[str] = []


def frees_between_queries(clear: Callable[[], None]) -> None:
    """Register what empties a cache of the worker process once it works for another query."""
    _CACHES.append(clear)


def _hand_back() -> None:
    """Give what the worker has freed back to the system, which the allocators else keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that has no such call
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, so that only their Python objects exist at a time.

    Workers outlive tasks. Caches serve all tasks of a query, stages that run
    side by side included, and are emptied here as another query's first task begins.
    """
    context = TaskContext.get()
    if context is not None:
        query = context.getLocalProperty("spark.sql.execution.id") or f"stage {context.stageId()}"
        if [query] != _serving:
            _serving[:] = [query]
            for clear in _CACHES:
                clear()
            _hand_back()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for low in range(0, batch.num_rows, step):
            yield from _halved(batch.slice(low, step))


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A slice whose long texts stand together is cut further, down to single rows."""
    if batch.num_rows > 1 and batch.nbytes > 2 * SLICE_BYTES:
        half = batch.num_rows // 2
        yield from _halved(batch.slice(0, half))
        yield from _halved(batch.slice(half))
    else:
        yield batch


def drawn_within(rows: DataFrame, order: list[str], size: str, max_bytes: int) -> list:
    """The rows in ``order``, collected, as far as their ``size`` adds up to ``max_bytes``, one at least.

    ``rows`` has a bounded number of rows; they are written once, and their
    sizes are looked at before any data go to the driver.
    """
    rows = materialize(rows, "sample")
    total = kept = 0
    for r in rows.select(*order, size).orderBy(*order).collect():
        total += r[size]
        if kept and total > max_bytes:
            break
        kept += 1
    return rows.orderBy(*order).limit(kept).collect()


class RowBuffer:
    """Collects rows column by column and gives them out as Arrow batches."""

    def __init__(self, schema: pa.Schema, flush_bytes: int = FLUSH_BYTES, flush_rows: int = 50_000):
        self.schema, self.flush_bytes, self.flush_rows = schema, flush_bytes, flush_rows
        self._reset()

    def _reset(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = self.rows = 0

    def add(self, row: tuple, weight: int = 0) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.bytes += weight
        self.rows += 1

    @property
    def full(self) -> bool:
        return self.bytes >= self.flush_bytes or self.rows >= self.flush_rows

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self._reset()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def map_rows(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[tuple[tuple, int]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` for a function that turns a batch into (row, weight) pairs.

    Output batches are bounded in bytes, whatever the size of the texts.
    """
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = RowBuffer(arrow)
        for batch in sliced(batches):
            for row, weight in function(batch):
                buffer.add(row, weight)
                if buffer.full:
                    yield buffer.take()
        if buffer.rows:
            yield buffer.take()

    return df.mapInArrow(run, schema)


#: Bits of a key filter at most: 32 MB, whatever the number of keys.
FILTER_BITS = 1 << 28
_BUCKET_BITS = 1 << 15


def key_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """A bitmap of 64-bit keys in rows ``bucket, bits`` of 4 KB, and its size: 16 bits a key, up to FILTER_BITS.

    It holds every key, and by chance others: beyond the bound more of them,
    up to all. What passes must be joined with the keys themselves.
    """
    n_bits = min(FILTER_BITS, max(_BUCKET_BITS, 1 << (16 * n_keys).bit_length()))
    at = F.pmod(F.col(key), F.lit(n_bits))
    marks = keys.select(F.floor(at / _BUCKET_BITS).alias("bucket"), F.pmod(at, F.lit(_BUCKET_BITS)).alias("bit"))
    return marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), n_bits


def passes(df: DataFrame, key: str, bitmap: tuple[DataFrame, int], flag: str) -> DataFrame:
    """``df`` with the column ``flag``: whether the filter holds ``key``. Nothing is shuffled; null keys don't pass."""
    bits, n_bits = bitmap
    bits = bits.select(F.col("bucket").alias(f"{flag}_bucket"), F.col("bits").alias(f"{flag}_bits"))
    at = F.pmod(F.col(key), F.lit(n_bits))
    bit = F.pmod(at, F.lit(_BUCKET_BITS))
    byte = F.substring(f"{flag}_bits", F.floor(bit / 8).cast("int") + 1, 1)
    value = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int"))
    joined = df.join(F.broadcast(bits), F.floor(at / _BUCKET_BITS) == F.col(f"{flag}_bucket"), "left")  # 32 MB at most
    return joined.withColumn(flag, F.coalesce(value > 0, F.lit(False))).drop(f"{flag}_bucket", f"{flag}_bits")


def left_join_few(body: DataFrame, few: DataFrame, on: list[tuple[str, str]], key: str, few_key: str) -> DataFrame:
    """Left join of ``body`` with a written table of rather few rows, equal nulls matching.

    Only rows of ``body`` whose 64-bit ``key`` may be among ``few_key`` are
    shuffled; the others pass as they are, with nulls. Column names must differ.
    """
    marked = passes(body, key, key_filter(few, few_key, few.count()), "may_match")
    match = None
    for a, b in on:
        same = body[a].eqNullSafe(few[b])
        match = same if match is None else match & same
    near = marked.filter("may_match").drop("may_match").join(few, match, "left")
    rest = marked.filter("not may_match").drop("may_match")
    return near.unionByName(rest, allowMissingColumns=True)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def source_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns under internal names, so that further columns can't clash."""
    return df.select(*(F.col(f"`{column}`").alias(name) for name, column in wanted.items()))


def mapped(frame: DataFrame, function: Callable, schema: str) -> DataFrame:
    return frame.mapInArrow(function, schema)
