"""Making the package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application; the driver serves the archive."""
    context = spark.sparkContext
    if getattr(context, "_lamina_shipped", False):
        return
    root = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="lamina-"), "lamina.zip")
    with zipfile.ZipFile(where, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("lamina") / path.relative_to(root))
    context.addPyFile(where)
    context._lamina_shipped = True
