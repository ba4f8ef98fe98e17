"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session, for drivers that were not started with the package on everyone's path: Spark serves the file to every executor."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_quillstone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillstone-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := f"{folder}/{package.name}.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(path)
    context._quillstone_shipped = True
