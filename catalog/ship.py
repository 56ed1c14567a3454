"""Make the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add ``tidewire`` to the session's files once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tidewire-"), "tidewire.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(_ROOT, "tidewire")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, _ROOT))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
