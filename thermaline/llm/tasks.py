"""Arrow tasks whose code is sent along with the application."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the application's executors, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='thermaline-code-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on every executor."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
