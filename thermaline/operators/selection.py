"""Filters of the interactive questions: periods, boxes, walls, sensors, ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.schema import PERIODS, periods_table, small_table


def in_period(df: DataFrame, period: str | None) -> DataFrame:
    """one period, or all."""
    return df if period is None else df.where(F.col("period") == period)


def in_periods(df: DataFrame, periods: Sequence[str] | None) -> DataFrame:
    """several periods, or all."""
    return df if periods is None else df.where(F.col("period").isin(*periods))


def in_box(
    df: DataFrame,
    box_id: int,
    walls: Sequence[int] | None = None,
    sensors: Sequence[int] | None = None,
    wall_type: str | None = None,
) -> DataFrame:
    """F5 + F6: one box, and in it some walls, sensors or a treatment."""
    chosen = df.where(F.col("box_id") == box_id)
    if walls is not None:
        chosen = chosen.where(F.col("wall_id").isin(*walls))
    if sensors is not None:
        chosen = chosen.where(F.col("sensor_id").isin(*sensors))
    if wall_type is not None:
        chosen = chosen.where(F.col("wall_type") == wall_type)
    return chosen


def with_wall_type(df: DataFrame) -> DataFrame:
    """rows with a known treatment."""
    return df.where(F.col("wall_type").isNotNull())


def exclude_sensors(sensor: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """The sensor level without the given (box, sensor) pairs; roll up again afterwards."""
    if not pairs:
        return sensor
    excluded = small_table(sensor.sparkSession, pairs, "box_id int, sensor_id int")
    return sensor.join(excluded, ["box_id", "sensor_id"], "left_anti")


def with_range_flag(df: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """``in_range`` - the row's time lies in the range of its own period, both ends inclusive.

    NULL where the time or the period's range is unknown.
    """
    ranges = periods_table(df.sparkSession, periods)
    return (
        df.join(ranges, "period", "left")
        .withColumn("in_range", F.col("timestamp").between(F.col("start"), F.col("end")))
        .drop("start", "end")
    )


def in_period_range(df: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """F7 as a filter."""
    return with_range_flag(df, periods).where("in_range").drop("in_range")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """O3: the known values of a column in order, for pickers."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
