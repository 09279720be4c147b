"""Make the package importable in Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package as a zip to every executor, once per application. Spark
    distributes the file itself, so nothing has to share the driver's folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="skyweft-py-"), "skyweft.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
