"""Puts this package where a cluster's Python workers can import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_shoal_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves it until then
    archive = Path(folder) / "shoal.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._shoal_shipped = True
