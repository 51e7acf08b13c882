"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def archive(folder: str) -> str:
    """The package's sources as one archive in a folder of the driver."""
    root = Path(__file__).resolve().parent.parent
    out = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    return out


def ship(spark: SparkSession) -> None:
    """Spark hands the archive to every executor, those that come later included."""
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(archive(folder))
