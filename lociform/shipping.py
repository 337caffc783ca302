"""Ships this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_lociform_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lociform-")) / "lociform_modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._lociform_shipped = True


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def grouped(df: DataFrame, keys, function, schema) -> DataFrame:
    """``applyInPandas`` with a function of this package."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(function, schema)
