"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application; returns ``spark``.

    Nothing is sent where ``PYTHONPATH`` already names the folder, since the
    workers inherit it.
    """
    top = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return spark
    handle, name = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
    return spark
