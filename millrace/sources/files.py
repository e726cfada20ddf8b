"""Sources and sinks by format, and interchange with pandas and Arrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Formats that hold typed columns; the text of a ``text`` file is its only column.
FORMATS = ("parquet", "orc", "csv", "json", "xml", "text")


def read(spark: SparkSession, fmt: str, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Read a format. A schema is needed where the files have none: inference reads everything twice."""
    if fmt not in (*FORMATS, "binaryFile", "avro", "jdbc", "kafka"):
        raise ValueError(f"no source for {fmt}")
    if fmt in ("csv", "json", "xml") and schema is None and not options.get("inferSchema"):
        raise ValueError(f"{fmt} needs a schema (or inferSchema=True)")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def write(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if fmt not in (*FORMATS, "avro", "jdbc", "kafka"):
        raise ValueError(f"no sink for {fmt}")
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, sort: bool = True) -> None:
    """A table whose later joins and aggregates on ``keys`` need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if sort else writer).saveAsTable(table)


def inline_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
