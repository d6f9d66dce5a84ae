"""Bring this package to the executors, which share no folder with the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules along once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
