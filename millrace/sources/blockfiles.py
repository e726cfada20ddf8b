"""A data source for tables in splittable block files: reads that skip blocks, whole commits, and streams.

A file is a row of blocks. A block is a mark of 16 bytes, the lengths and a
checksum, the smallest and largest values of its columns, and compressed Arrow
data. A task that reads a byte range starts at the first mark in it and reads
the blocks that begin in it, so one file may be read by many tasks.

A write puts its files below ``_staged`` and names them in a numbered commit
when all tasks are done; only named files are read, so a write that is aborted,
or whose driver is lost, leaves nothing that a reader sees. The commits are
also what a stream counts its progress in.

    spark.dataSource.register(BlockFiles)
    df.write.format("blocks").mode("append").save(path)
    spark.read.format("blocks").load(path)
    blockfiles.read(spark, path, where=[("o_orderkey", "<", 700)])
    spark.readStream.format("blocks").load(path)

``path`` is in a file system that all executors share; file: and what pyarrow
opens, such as hdfs: and s3:, are possible.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Fixed value: the mark that a block begins with.
MARK = bytes.fromhex("8d4d696c6c726163652d426c6f636b0a")
_HEAD = struct.Struct("<III")  # length of the statistics, length of the data, checksum of both
#: Rows of a block, bytes of a split.
BLOCK_ROWS, SPLIT_BYTES = 8192, 32 << 20
_COMPARED = (bool, int, float, str)


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _bounds(batch: pa.RecordBatch) -> dict[str, list]:
    """Smallest and largest value of the columns that filters compare; none where there is only null, or NaN."""
    found = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)):
            continue
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            continue
        both = pc.min_max(column).as_py()
        if both["min"] is not None and (not isinstance(both["min"], float) or abs(both["min"]) + abs(both["max"]) < float("inf")):
            found[name] = [both["min"], both["max"]]
    return found


def pack(batch: pa.RecordBatch) -> bytes:
    """One block."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    data, stats = sink.getvalue().to_pybytes(), json.dumps(_bounds(batch)).encode()
    return MARK + _HEAD.pack(len(stats), len(data), zlib.crc32(stats + data)) + stats + data


def may_hold(stats: dict[str, list], wanted: list[tuple[str, str, object]]) -> bool:
    """Whether a block with such bounds may have rows that satisfy all comparisons (column, op, value)."""
    for column, op, value in wanted:
        if column not in stats:
            continue
        low, high = stats[column]
        values = value if op == "in" else [value]
        if not all(isinstance(v, _COMPARED) and isinstance(v, str) == isinstance(low, str) for v in values):
            continue
        fits = {
            "=": lambda v, low=low, high=high: low <= v <= high,
            "in": lambda v, low=low, high=high: low <= v <= high,
            "<": lambda v, low=low: low < v,
            "<=": lambda v, low=low: low <= v,
            ">": lambda v, high=high: high > v,
            ">=": lambda v, high=high: high >= v,
        }[op]
        if not any(fits(v) for v in values):
            return False
    return True


class DamagedBlock(ValueError):
    """A block's checksum is wrong, or it ends too early."""


def blocks_of(stream, low: int, high: int, size: int, wanted: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks that begin in [low, high) of an open file and may satisfy the comparisons."""
    at = _next_mark(stream, low, min(high, size))
    while at is not None and at < high and at < size:
        stream.seek(at)
        head = stream.read(len(MARK) + _HEAD.size)
        if len(head) < len(MARK) + _HEAD.size or not head.startswith(MARK):
            raise DamagedBlock(f"no block at {at}")
        n_stats, n_data, checksum = _HEAD.unpack(head[len(MARK) :])
        stats = stream.read(n_stats)
        if may_hold(json.loads(stats), wanted) if len(stats) == n_stats else True:
            data = stream.read(n_data)
            if len(data) < n_data or zlib.crc32(stats + data) != checksum:
                raise DamagedBlock(f"the block at {at} is damaged")
            yield from pa.ipc.open_stream(data)
        at += len(head) + n_stats + n_data


def _next_mark(stream, low: int, high: int, step: int = 1 << 16) -> int | None:
    """The first mark that begins in [low, high) and has a sound head; data that look like a mark don't."""
    at = low
    while at < high:
        stream.seek(at)
        window = stream.read(step + len(MARK))
        place = window.find(MARK)
        while 0 <= place and at + place < high:
            stream.seek(at + place + len(MARK))
            head = stream.read(_HEAD.size)
            if len(head) == _HEAD.size:
                n_stats, n_data, checksum = _HEAD.unpack(head)
                body = stream.read(n_stats + n_data)
                if len(body) == n_stats + n_data and zlib.crc32(body) == checksum:
                    return at + place
            place = window.find(MARK, place + 1)
        at += step
    return None


@dataclass
class _Split(InputPartition):
    file: str
    low: int
    high: int
    size: int


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


def _commits(path: str) -> list[int]:
    """The numbers of the commits, in order."""
    from pyarrow.fs import FileSelector

    fs, folder = _open(path)
    found = fs.get_file_info(FileSelector(f"{folder}/_commits", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def _commit_of(path: str, number: int) -> dict:
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/_commits/{number:012d}.json") as f:
        return json.loads(f.read())


def _live(path: str, upto: int | None = None) -> list[dict]:
    """The commits that count: from the last that replaced all before it."""
    found: list[dict] = []
    for number in _commits(path):
        if upto is None or number < upto:
            commit = _commit_of(path, number)
            found = [commit] if commit["overwrite"] else [*found, commit]
    return found


class _Reads:
    """What batch and stream readers share: splits, and the rows of a split."""

    path: str
    names: list[str]
    wanted: list[tuple[str, str, object]]
    split_bytes: int

    def _splits(self, files: list[list]) -> list[_Split]:
        return [
            _Split(name, low, min(size, low + self.split_bytes), size) for name, size in files for low in range(0, size, self.split_bytes)
        ]

    def _rows(self, split: _Split) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(self.path)
        with fs.open_input_file(f"{folder}/data/{split.file}") as stream:
            for batch in blocks_of(stream, split.low, split.high, split.size, self.wanted):
                yield batch.select(self.names)


class BlockReader(_Reads, DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int, wanted: list[tuple[str, str, object]]):
        self.path, self.names, self.split_bytes, self.wanted = path, schema.fieldNames(), split_bytes, wanted

    def partitions(self) -> list[_Split]:
        return self._splits([f for commit in _live(self.path) for f in commit["files"]]) or [_Split("", 0, 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self._rows(partition)


class BlockStreamReader(_Reads, DataSourceStreamReader):
    """Offsets are numbers of commits: a batch has the files of the commits from one to the other."""

    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.names, self.split_bytes, self.wanted = path, schema.fieldNames(), split_bytes, []

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(_commits(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        numbers = [n for n in _commits(self.path) if start["commit"] <= n < end["commit"]]
        return self._splits([f for n in numbers for f in _commit_of(self.path, n)["files"]]) or [_Split("", 0, 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self._rows(partition)

    def commit(self, end: dict) -> None:
        pass


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, block_rows: int):
        self.path, self.schema_json, self.overwrite, self.block_rows = path, schema.json(), overwrite, block_rows
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, folder = _open(self.path)
        name, size, waiting, rows = f"{uuid.uuid4().hex}.blk", 0, [], 0
        staged = f"{folder}/_staged/{self.write_id}"
        fs.create_dir(staged, recursive=True)
        with fs.open_output_stream(f"{staged}/{name}") as out:
            for batch in iterator:
                waiting.append(batch)
                rows += batch.num_rows
                while rows >= self.block_rows:
                    table = pa.Table.from_batches(waiting)
                    data = pack(table.slice(0, self.block_rows).combine_chunks().to_batches()[0])
                    size += out.write(data)
                    waiting = table.slice(self.block_rows).to_batches()
                    rows -= self.block_rows
            if rows:
                size += out.write(pack(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]))
        return _Written([(name, size)] if size else [])

    def commit(self, messages: list[_Written | None]) -> None:
        """Move the files that finished tasks name, then name them: the last step makes the write visible, whole."""
        fs, folder = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        for kind in ("data", "_commits"):
            fs.create_dir(f"{folder}/{kind}", recursive=True)
        for name, _ in files:
            fs.move(f"{folder}/_staged/{self.write_id}/{name}", f"{folder}/data/{name}")
        number = max(_commits(self.path), default=-1) + 1
        record = {"schema": json.loads(self.schema_json), "files": files, "overwrite": self.overwrite}
        hidden = f"{folder}/_staged/{self.write_id}.json"
        fs.create_dir(f"{folder}/_staged", recursive=True)
        with fs.open_output_stream(hidden) as out:
            out.write(json.dumps(record).encode())
        fs.move(hidden, f"{folder}/_commits/{number:012d}.json")
        self._clear(fs, folder)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        staged = f"{folder}/_staged/{self.write_id}"
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


class BlockFiles(DataSource):
    """Options: ``path``, ``block_rows`` of a written block, ``split_bytes`` of a reading task, ``where``. One writer at a time.

    ``where`` is what :func:`read` makes of its comparisons. Spark's own hook for
    pushed filters isn't used: a DataFrame that is filtered once keeps the pushed
    reader (Spark 4.1.2), and later uses of it without the filter would miss rows.
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    @property
    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        live = _live(self._path)
        if not live:
            raise ValueError(f"nothing has been written to {self._path}; name a schema")
        return StructType.fromJson(live[-1]["schema"])

    def reader(self, schema: StructType) -> BlockReader:
        wanted = [tuple(w) for w in json.loads(self.options.get("where", "[]"))]
        return BlockReader(self._path, schema, int(self.options.get("split_bytes", SPLIT_BYTES)), wanted)

    def streamReader(self, schema: StructType) -> BlockStreamReader:
        return BlockStreamReader(self._path, schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self._path, schema, overwrite, int(self.options.get("block_rows", BLOCK_ROWS)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockFiles)


def read(spark: SparkSession, path: str, where: list[tuple[str, str, object]] = (), **options) -> DataFrame:
    """The rows that satisfy all comparisons (column, op, value) with op one of = in < <= > >=.

    Blocks whose bounds exclude them aren't read; Spark looks at the rows of the
    others. Values are numbers, strings or booleans; nulls satisfy nothing.
    """
    register(spark)
    ops = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "in": "isin"}
    df = spark.read.format("blocks").options(**options).option("where", json.dumps([list(w) for w in where])).load(path)
    for column, op, value in where:
        df = df.filter(getattr(F.col(column), ops[op])(value))
    return df
