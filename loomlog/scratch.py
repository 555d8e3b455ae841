"""Folders for intermediate tables, on storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir.

    Only a local session (tests) may leave that unset and gets a temporary folder, which goes at exit. On a cluster
    a folder of one machine would lose rows, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="loomlog-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _remove(fs, path) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        fs.delete(path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    while _OWN:
        _remove(*_OWN.pop())


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _OWN.append((where.getFileSystem(spark._jsc.hadoopConfiguration()), where))
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a new shared folder: worked out once, read by columns, and without lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
