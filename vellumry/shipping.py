"""Making the package known to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application.

    Nothing is sent where the search path of Python workers names this copy already.
    The archive is served by the driver; executors that join later fetch it as well.
    """
    root = os.path.dirname(HERE)
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _shipped or os.path.realpath(root) in paths:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="vellumry-"), "vellumry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(HERE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
