"""Sends this package to the executors, once a Spark context."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")) + sorted(root.rglob("*.toml")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="logloom-"), f"{root.name}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
