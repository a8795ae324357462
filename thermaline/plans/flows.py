"""From readings to the three levels, and from an interactive question to its frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from thermaline.operators.curate import (
    curated_rows,
    curation_totals,
    file_verdicts,
    judged_rows,
    quarantined_lines,
)
from thermaline.operators.levels import box_level, sensor_level, wall_level
from thermaline.operators.selection import exclude_sensors, in_period
from thermaline.operators.series import smooth
from thermaline.schema import BOX_SMOOTHED, PERIODS, READINGS_SCHEMA, WALL_SMOOTHED
from thermaline.sources.logger_files import CURATE, cut_tails, load_logger_files, readings_only
from thermaline.sources.sinks import read_curated, write_curated, write_quarantine, write_verdicts
from thermaline.staging import staging_scope


class Levels:
    """The three lazy frames every question starts from; wall and box roll up from the sensors."""

    def __init__(self, sensor: DataFrame):
        self.sensor = sensor

    @cached_property
    def wall(self) -> DataFrame:
        return wall_level(self.sensor)

    @cached_property
    def box(self) -> DataFrame:
        return box_level(self.sensor)


class Answer(Levels):
    """Levels after a period filter and smoothing.

    Smoothing runs per series: per (period, box) and per (period, box, wall), never across them.
    """

    def __init__(self, levels: Levels, period: str | None, smoothing: str | None):
        super().__init__(in_period(levels.sensor, period))
        self._finish: Callable[[DataFrame, list[str], list[str]], DataFrame] = (
            lambda df, columns, keys: smooth(in_period(df, period), columns, smoothing, keys)
        )
        self._levels = levels

    @cached_property
    def wall(self) -> DataFrame:
        return self._finish(self._levels.wall, WALL_SMOOTHED, ["period", "box_id", "wall_id"])

    @cached_property
    def box(self) -> DataFrame:
        return self._finish(self._levels.box, BOX_SMOOTHED, ["period", "box_id"])


def build_levels(readings: DataFrame, width: str = "10 minutes") -> Levels:
    """Readings of all periods to the three levels; the period is a key throughout."""
    return Levels(sensor_level(readings, width))


def save_sensor_level(sensor: DataFrame, table: str, buckets: int) -> DataFrame:
    """Keep the sensor level as a table for many questions.

    Partitioned by period (a period filter prunes folders) and bucketed by box and time, so the wall
    and box roll-ups of every later question, with or without excluded sensors, need no exchange. Rows are
    dealt to the buckets before the write, so there is one file per bucket and period.
    """
    spark: SparkSession = sensor.sparkSession
    (
        sensor.repartition(buckets, "box_id", "timestamp")
        .write.mode("overwrite")
        .partitionBy("period")
        .bucketBy(buckets, "box_id", "timestamp")
        .sortBy("box_id", "timestamp")
        .saveAsTable(table)
    )
    return spark.table(table)


def answer(
    levels: Levels,
    period: str | None = None,
    excluded: Sequence[tuple[int, int]] = (),
    smoothing: str | None = None,
) -> Answer:
    """The frames behind one question: exclusion first, then the period, then smoothing.

    Exclusion rolls up again from the sensor level only.
    """
    base = Levels(exclude_sensors(levels.sensor, excluded)) if excluded else levels
    return Answer(base, period, smoothing)


def load_levels(spark: SparkSession, base: str, width: str = "10 minutes") -> Levels:
    """Folders of logger files to the three levels."""
    return build_levels(readings_only(load_logger_files(spark, base)), width)


def load_curated(spark: SparkSession, base: str, width: str = "10 minutes") -> Levels:
    """Curated periods (see :func:`curate_folder`) to the three levels.

    As when raw files are loaded for analysis, a file's name must parse and its tail is cut; what counts is the file
    as curation left it, clipped to its period.
    """
    rows = read_curated(spark, base).where("box_id is not null and sensor_id is not null")
    kept = cut_tails(rows, ["period", "file"])
    return build_levels(kept.select(*READINGS_SCHEMA.fieldNames()), width)


def curate_folder(
    spark: SparkSession,
    base: str,
    target: str,
    periods: Sequence[tuple] = tuple(PERIODS),
    glob: str = "*.csv",
    folders: bool = False,
) -> DataFrame:
    """Folders of raw logger files to curated periods, quarantine and verdicts below ``target``.

    Excluded files go to the quarantine whole, line by line, whether they were read or not; every file has a row
    among the verdicts. A new run replaces all of it. Returns the totals per outcome. What was staged on the way is
    deleted at the end.
    """
    with staging_scope(spark):
        loaded = load_logger_files(spark, base, glob, folders, CURATE)
        rows = loaded.readings.withColumnRenamed("period", "source_period")
        failed = loaded.files.where("reason is not null").withColumnRenamed("period", "source_period")
        written = write_verdicts(file_verdicts(rows, periods, failed), target)
        verdicts = spark.read.parquet(written)
        write_curated(curated_rows(judged_rows(rows, verdicts), periods).drop("path"), target)
        write_quarantine(quarantined_lines(loaded.lines, loaded.files, verdicts), target)
    return curation_totals(spark.read.parquet(written))
