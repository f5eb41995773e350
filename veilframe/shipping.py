"""Sends this library's source to the executors, for clusters on which it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Once for each Spark context; the driver serves the archive to executors, which need no shared folder for it."""
    context = spark.sparkContext
    if not getattr(context, "_veilframe_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="veilframe-")) / "veilframe_source.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(ROOT.rglob("*.py")):
                out.write(path, path.relative_to(ROOT.parent))
        context.addPyFile(str(archive))
        context._veilframe_shipped = True
    return spark
