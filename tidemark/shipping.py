"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once; executors fetch it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="tidemark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = folder / "tidemark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
