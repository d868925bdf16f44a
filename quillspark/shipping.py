"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session, once, so that executors without a copy can import it."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it already runs from such a zip
        folder = os.path.realpath(tempfile.mkdtemp(prefix="quillspark-package-"))  # the session reads it as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(path := f"{folder}/quillspark-package.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        context.addPyFile(path)
    context._quillspark_shipped = True
