"""Makes this package importable for Python workers, wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ensure_package(spark: SparkSession) -> None:
    """Ships the package as a zip, once a context, unless PYTHONPATH hands it to the workers already."""
    context = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in known or getattr(context, "_learnmill_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="learnmill-"), "learnmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "learnmill").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(path)
    context._learnmill_shipped = True
