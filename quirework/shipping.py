"""Sends this package to executors that cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: a zip of the package's modules, served by the driver and put on every worker's path."""
    context = spark.sparkContext
    if getattr(context, "_quirework_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quirework-"), "quirework.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(here)))
    context.addPyFile(path)
    context._quirework_shipped = True
