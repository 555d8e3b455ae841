"""Gives the executors' Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application; functions in them are pickled by name."""
    sc = spark.sparkContext
    if getattr(sc, "_loomlog_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="loomlog-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_HERE.rglob("*.py")):
            z.write(source, source.relative_to(_HERE.parent))
    sc.addPyFile(path)
    sc._loomlog_shipped = True
