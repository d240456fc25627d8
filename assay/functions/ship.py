"""Puts this package on the Python path of the executors, and bounds what is handed to Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
#: Bytes of payloads that Spark hands to Python together, and the setting that says so.
TOGETHER, BATCH = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; Spark's own file server delivers it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="assay-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, f"{ROOT.name}/{file.relative_to(ROOT)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def small_batches(spark: SparkSession) -> None:
    """Have the session hand payloads to Python TOGETHER bytes at a time; a size that it has been given stays.

    Spark's own batches are of 64 MB, of which a worker holds two: its memory would follow the size of a task until they are full.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(TOGETHER))
