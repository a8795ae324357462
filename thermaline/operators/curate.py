"""Sorting files into experiment periods and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.operators.selection import with_range_flag
from thermaline.operators.series import regenerate_timestamps
from thermaline.schema import PERIODS, periods_table, small_table
from thermaline.staging import stage

# A file of the first period must fit it as a whole, one of the second is clipped.
WHOLE_FILE_PERIODS = ["Period1"]

# Files whose clock was wrong.
FILES_TO_REPAIR = [
    "GW2.1_121125.csv",
    "GW2.13_121125.csv",
    "GW2.8_121125.csv",
    "GW1.8_121125.csv",
]

EXCLUDED = "excluded"
_FILE = ["source_period", "file"]


def _fits_other_period(periods: Sequence[tuple]) -> Column:
    fits = F.lit(False)
    for name, start, end in periods:
        fits = fits | (
            (F.col("source_period") != name)
            & (F.col("orig_start") >= F.lit(str(start)).cast("timestamp_ntz"))
            & (F.col("orig_end") <= F.lit(str(end)).cast("timestamp_ntz"))
        )
    return fits


def file_verdicts(
    rows: DataFrame, periods: Sequence[tuple] = tuple(PERIODS), failed: DataFrame | None = None
) -> DataFrame:
    """Verdict per file: ``status`` is a period name or ``excluded``, with the reason.

    ``rows`` has ``source_period, file, timestamp`` (NULL for unreadable times). ``failed`` adds files
    that could not be read at all, as ``source_period, file, reason``. ``rows`` of the result counts
    the kept rows of a kept file and the valid ones of an excluded file.
    """
    flagged = with_range_flag(
        rows.select(F.col("source_period").alias("period"), *_FILE, "timestamp"), periods
    )
    facts = flagged.groupBy(*_FILE).agg(
        F.min("timestamp").alias("orig_start"),
        F.max("timestamp").alias("orig_end"),
        F.count("timestamp").alias("valid_rows"),
        F.count_if(F.col("in_range")).alias("range_rows"),
    )
    ranges = periods_table(rows.sparkSession, periods).withColumnRenamed("period", "source_period")
    known = facts.join(ranges, "source_period", "left")
    whole = F.col("source_period").isin(*WHOLE_FILE_PERIODS)
    fits = (F.col("orig_start") >= F.col("start")) & (F.col("orig_end") <= F.col("end"))
    reason = (
        F.when(F.col("valid_rows") == 0, "no valid time")
        .when(whole & fits, None)
        .when(whole, "outside period")
        .when(F.col("range_rows") > 0, None)
        .when(F.col("orig_end") >= F.col("start"), "no rows in period range")
        .when(_fits_other_period(periods), "belongs to another period")
        .otherwise("outside period")
    )
    clipped = F.col("reason").isNull() & ~whole
    verdicts = (
        known.withColumn("reason", reason)
        .withColumn(
            "rows", F.when(clipped, F.col("range_rows")).otherwise(F.col("valid_rows"))
        )
        .select(*_FILE, "orig_start", "orig_end", "reason", "rows")
    )
    if failed is not None:
        unread = failed.select(*_FILE, "reason").withColumn("rows", F.lit(0).cast("bigint"))
        verdicts = verdicts.unionByName(unread, allowMissingColumns=True)
    return verdicts.withColumn(
        "status", F.when(F.col("reason").isNull(), F.col("source_period")).otherwise(EXCLUDED)
    )


def judged_rows(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with a valid time and the verdict of their file.

    The verdicts are staged first: Catalyst sees their size, broadcasts them while small, and else
    joins by file with AQE splitting large files.
    """
    staged = stage(verdicts.select(*_FILE, "status", "reason"), "verdicts")
    return rows.where(F.col("timestamp").isNotNull()).join(staged, _FILE)


def curated_rows(judged: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Rows to keep: whole files of the first period, rows in range of the second."""
    kept = judged.where(F.col("status") != EXCLUDED).withColumn("period", F.col("status"))
    whole = F.col("period").isin(*WHOLE_FILE_PERIODS)
    return (
        with_range_flag(kept, periods)
        .where(whole | F.col("in_range"))
        .drop("in_range", "status", "reason", "source_period")
    )


def quarantined_lines(lines: DataFrame, files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """K3: every line, as it was read, of the excluded files, also of those that could not be parsed.

    ``files`` (path, period, file) names the file of a line's path. The file name gets its source period in front.
    """
    excluded = verdicts.where(F.col("status") == EXCLUDED).select(*_FILE, "status", "reason")
    named = files.select("path", F.col("period").alias("source_period"), "file").join(excluded, _FILE)
    return lines.join(stage(named, "excluded-files"), "path").select(
        "status",
        "source_period",
        F.concat_ws("_", "source_period", "file").alias("file"),
        "reason",
        "block",
        "line_id",
        "raw",
    )


def quarantined_rows(judged: DataFrame) -> DataFrame:
    """K3: rows of excluded files, the name prefixed with its source period."""
    return judged.where(F.col("status") == EXCLUDED).withColumn(
        "file", F.concat_ws("_", "source_period", "file")
    )


def curation_totals(verdicts: DataFrame) -> DataFrame:
    """Files and rows per outcome."""
    return verdicts.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("rows").alias("rows")
    )


def repair_clocks(
    rows: DataFrame, order: Sequence[str], chunk: Column, files: Sequence[str] = tuple(FILES_TO_REPAIR)
) -> DataFrame:
    """F11 + W7: the rows of the named files, with regenerated times."""
    listed = small_table(rows.sparkSession, [(f,) for f in files], "file string")
    return regenerate_timestamps(
        rows.join(listed, "file", "left_semi"), ["file"], order, chunk
    )
