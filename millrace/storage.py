"""Places that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_known: set[str] = set()


def _base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`shared_dir` that no DataFrame reads any more."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _sweep(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; then the folder stays
        _delete(jvm, conf, folder)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset and the master is local (tests, a laptop) a local one is made and
    set; on a cluster executors couldn't see it, so that is an error. All paths
    of an application lie in one folder, which is deleted when the driver ends.
    """
    sc = spark.sparkContext
    folder = f"{_base(spark)}/millrace-{sc.applicationId}"
    if folder not in _known:
        _known.add(folder)
        atexit.register(_sweep, sc._jvm, sc._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: its lineage is cut, its rows are fixed."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
