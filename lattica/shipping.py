"""Python workers need this package; a session started elsewhere gets it as a file of the application."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers unless they'd find it: they look in PYTHONPATH and in their own folder."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(root) not in seen and getattr(context, "_lattica_shipped", None) is None:
        context._lattica_shipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lattica-')}/lattica", "zip", root, "lattica")
        context.addPyFile(context._lattica_shipped)
