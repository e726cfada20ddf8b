"""A source of its own kind: numbered rows, made by the executors, without input files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, rows: int, slices: int):
        self.rows, self.slices = rows, max(1, slices)

    def partitions(self) -> list[_Range]:
        edges = [self.rows * k // self.slices for k in range(self.slices + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i in range(partition.low, partition.high):
            yield i, f"row{i}"


class NumberedRows(DataSource):
    """``spark.read.format("numbered").option("rows", n).option("slices", k)``: id, name."""

    @classmethod
    def name(cls) -> str:
        return "numbered"

    def schema(self) -> str:
        return "id long, name string"

    def reader(self, schema) -> _Reader:
        return _Reader(int(self.options.get("rows", 0)), int(self.options.get("slices", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumberedRows)
