"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_lineaspark_shipped", False):
        return
    fd, name = tempfile.mkstemp(suffix=".zip", prefix="lineaspark-")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((ROOT / "lineaspark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(name)
    sc._lineaspark_shipped = True
