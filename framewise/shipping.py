"""Makes this package importable in the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors a zip of this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="framewise-code-")
    path = os.path.join(folder, "framewise.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(path)
    _done[sc.applicationId] = path
