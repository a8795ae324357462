"""Written intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A staged table survives the loss of executors, fixes row-order ids that must not be computed twice,
and gives Catalyst a true size, so that it broadcasts a small side on its own and shuffles a large one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def staging_dir(spark: SparkSession) -> str:
    """The session's shared folder; one is made only where the setting is absent (local runs)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="thermaline-")
    return _LOCAL_DIRS[context.applicationId]


def staging_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh path under the staging folder, never reused; deleted with the innermost scope, or the one ``outer`` of it."""
    path = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES[:-1][-1:] if outer else _SCOPES[-1:]:
        scope.append(path)
    return path


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    With ``outer`` it outlives the innermost scope: so a block's result is kept while what it staged on the way goes.
    """
    spark = df.sparkSession
    path = staging_path(spark, name, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it exists."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rename(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder to a place where nothing is."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    if not paths(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(paths(path), paths(target)):
        raise OSError(f"{path} can't be renamed to {target}")


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside, once the block has written its results elsewhere."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)
