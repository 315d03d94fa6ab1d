"""Python tasks that call this package need it on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        into = os.path.join(tempfile.mkdtemp(prefix="riskloom-"), "riskloom-library")  # served by the driver, holds no data
        spark.sparkContext.addPyFile(shutil.make_archive(into, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(app)
