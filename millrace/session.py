"""Sessions with settings that suit the engine at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Plans are re-optimised at run time: partitions are merged to a target size, skewed ones split.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app_name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """The active session, or a new one. Keyword settings have "_" for ".", and win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Tables:
    """Tables of a folder of Parquet files, by name: ``Tables(spark, folder).orders``. Nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        """Register the tables as views for SQL text; returns the session."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark
