"""Sends the package's code to a cluster's workers, once a Spark context."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers then import the package from the archive, wherever they run. No data goes along."""
    if (app := spark.sparkContext.applicationId) in _sent:
        return
    _sent.add(app)
    archive = Path(tempfile.mkdtemp(prefix="glyphflow-")) / "glyphflow_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted([*ROOT.glob("*.py"), *(ROOT / "glyphflow").rglob("*.py")]):
            z.write(p, p.relative_to(ROOT).as_posix())
    spark.sparkContext.addPyFile(str(archive))
