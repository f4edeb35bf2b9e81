"""Making the package importable on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a context; Spark distributes the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_causeway_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="causeway-package-")
    atexit.register(shutil.rmtree, folder, True)
    staged = Path(folder, "staged")
    shutil.copytree(HERE, staged / HERE.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder, "causeway-package")), "zip", staged))
    sc._causeway_shipped = True
