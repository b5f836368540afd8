"""Makes this package importable in Spark's Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, f"paperloom/{source.relative_to(here)}")
    context.addPyFile(str(archive))
    context._paperloom_shipped = True
