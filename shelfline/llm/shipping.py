"""The package on the executors' import path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    Python functions in the plans are imported there by name. Where PYTHONPATH
    names the package's folder already, nothing is sent.
    """
    application = spark.sparkContext.applicationId
    named = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if application in _SHIPPED or str(HOME) in named:
        return
    archive = Path(tempfile.mkdtemp()) / "shelfline.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted((HOME / "shelfline").rglob("*.py")):
            file.write(source, source.relative_to(HOME))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
