"""Exports, curated folders, quarantine and logger text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from thermaline.functions.timebins import format_logger_time
from thermaline.schema import MEASURES
from thermaline.staging import discard, rename

# Layout of a logger file - 14 filled preamble lines, then these columns.
PREAMBLE_LINES = 14
LOGGER_HEADER = "Date/Time,Value Heat Surface Sensor,Internal temp sensor,Out Air temp,Wall Type"


def export_level(df: DataFrame, base: str, level: str, period: str | None = None) -> str:
    """K1: one level as CSV under ``thermal_data_{level}_{period}.csv``; empty data is an error.

    The rows are counted while they are written beside the target, so the plan runs once. Only a complete export with
    rows takes the target's place; an empty or failed one leaves an earlier export as it is.
    """
    path = f"{base}/thermal_data_{level.lower()}_{period}.csv"
    fresh = f"{path}.{uuid.uuid4().hex}"
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    try:
        counted.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(fresh, header=True)
        if not written.get["rows"]:
            raise ValueError("No data available for export")
        discard(df.sparkSession, path)
        rename(df.sparkSession, fresh, path)
    finally:
        discard(df.sparkSession, fresh)
    return path


def write_curated(rows: DataFrame, base: str) -> str:
    """K2 + K4: kept rows, one folder per period; a new run replaces all periods."""
    path = f"{base}/curated"
    _replace(rows, "period", path)
    return path


def _replace(rows: DataFrame, folder: str, path: str) -> None:
    """Write one folder per value; whatever an earlier run left at ``path`` goes, also folders not written now."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(folder).parquet(path)


def read_curated(spark: SparkSession, base: str) -> DataFrame:
    """The curated rows; a filter on ``period`` prunes folders."""
    return spark.read.parquet(f"{base}/curated")


def write_verdicts(verdicts: DataFrame, base: str) -> str:
    """K3: one row per file, also for files without any line."""
    path = f"{base}/verdicts"
    verdicts.write.mode("overwrite").parquet(path)
    return path


def write_quarantine(rows: DataFrame, base: str) -> str:
    """K3 + K4: excluded lines or rows with status, reason and source period."""
    path = f"{base}/quarantine"
    _replace(rows, "status", path)
    return path


def read_quarantine(spark: SparkSession, base: str) -> DataFrame:
    """The lines of excluded files."""
    return spark.read.parquet(f"{base}/quarantine")


def with_logger_text(df: DataFrame) -> DataFrame:
    """K5: the row's time as ``date_text`` in the logger's format."""
    return df.withColumn("date_text", format_logger_time(F.col("timestamp")))


def write_logger_text(rows: DataFrame, path: str, header: str = LOGGER_HEADER) -> str:
    """K2 + K5: rows as logger text - preamble, header, data in file order.

    ``rows`` has ``folder, file, file_order, date_text``, the measures and ``wall_type`` as text, and
    may have a ``header`` of its own. Each file is sorted and written by one task, into a folder that
    bears its name; keep single files at a size a logger would write (see the caller's rotation).
    """
    cells = ["date_text", *MEASURES, "wall_type"]
    given = F.col("header") if "header" in rows.columns else F.lit(header)
    data = rows.select(
        "folder",
        "file",
        "file_order",
        F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]).alias(
            "line"
        ),
        given.alias("header"),
    )
    number = F.sequence(F.lit(1), F.lit(PREAMBLE_LINES))
    preamble = F.transform(number, lambda n: F.concat(F.lit("# logger line "), n.cast("string")))
    heads = (
        data.select("folder", "file", "header")
        .distinct()
        .select(
            "folder",
            "file",
            F.posexplode(F.concat(preamble, F.array("header"))).alias("n", "line"),
        )
        .select("folder", "file", (F.col("n") - 1_000).cast("bigint").alias("file_order"), "line")
    )
    (
        heads.unionByName(data.drop("header"))
        .repartition("folder", "file")
        .sortWithinPartitions("folder", "file", "file_order")
        .select("folder", "file", "line")
        .write.partitionBy("folder", "file")
        .text(path)
    )
    return path
