"""Sending the library to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def _archive() -> str:
    """A zip file of the package, with compiled modules beside the sources."""
    folder = tempfile.mkdtemp(prefix="rowframe-")
    copy = os.path.join(folder, "rowframe")
    shutil.copytree(_PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
    path = os.path.join(folder, "rowframe.zip")
    with zipfile.PyZipFile(path, "w") as out:
        out.writepy(copy)
        for at, _, names in os.walk(copy):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    out.write(file, os.path.relpath(file, folder))
    shutil.rmtree(copy)
    return path


def ship(spark: SparkSession) -> None:
    """Makes the library importable on all executors, once a context; Spark's file server hands the archive out."""
    context = spark.sparkContext
    if not getattr(context, "_rowframe_shipped", False):
        context.addPyFile(_archive())
        context._rowframe_shipped = True
