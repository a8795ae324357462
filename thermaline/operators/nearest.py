"""Nearest-in-time comparison: probe times, as-of join with tolerance, extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.functions.timebins import MICROS_PER_DAY, floor_to, from_micros, micros
from thermaline.staging import stage

# Tolerance of the comparison, and days shown in the short report.
TOLERANCE_MINUTES = 5
REPORT_DAYS = 8


def noon_probes(df: DataFrame, group: Sequence[str] = (), timestamp: str = "timestamp") -> DataFrame:
    """Per day, the reading time closest to noon; the earlier one on a tie.

    The gap to noon and its side are packed in one number, so this is a plain hash aggregate over all
    readings with one number per (group, day) and task.
    """
    t = micros(F.col(timestamp))
    day = floor_to(t, MICROS_PER_DAY)
    noon = day + MICROS_PER_DAY // 2
    packed = F.abs(t - noon) * 2 + (t > noon).cast("bigint")
    nearest = (
        df.where(F.col(timestamp).isNotNull())
        .select(*group, day.alias("_day"), packed.alias("_packed"))
        .groupBy(*group, "_day")
        .agg(F.min("_packed").alias("_packed"))
    )
    gap = F.shiftright("_packed", 1)
    signed = F.when(F.col("_packed") % 2 == 1, gap).otherwise(-gap)
    return nearest.select(
        *group, from_micros(F.col("_day") + MICROS_PER_DAY // 2 + signed).alias("probe_time")
    )


def first_days(probes: DataFrame, days: int = REPORT_DAYS) -> DataFrame:
    """The probes of the first days."""
    return probes.orderBy("probe_time").limit(days)


def nearest_in_time(
    probes: DataFrame,
    readings: DataFrame,
    group: Sequence[str],
    series: Sequence[str],
    values: Sequence[str],
    tolerance_minutes: int = TOLERANCE_MINUTES,
    order: Sequence[str] = (),
    timestamp: str = "timestamp",
) -> DataFrame:
    """For each probe and series, the reading nearest in time within the tolerance.

    Both sides share ``group``. Readings fall in buckets as wide as the tolerance; a probe looks in
    its own bucket and both neighbours, so the join is an equi-join. Probes and the list of series are
    staged: Catalyst sees their size, broadcasts them while small and shuffles otherwise. A series
    without a reading near the probe stays, with NULL values and ``has_data`` false.
    """
    tolerance = tolerance_minutes * 60_000_000
    small = stage(probes.select(*group, "probe_time"), "probes")
    members = stage(readings.select(*group, *series).distinct(), "series")
    targets = small.withColumn("_p", micros(F.col("probe_time"))).withColumn(
        "_bucket",
        F.explode(
            F.array(
                *[floor_to(F.col("_p"), tolerance) + step for step in (-tolerance, 0, tolerance)]
            )
        ),
    )
    timed = readings.select(
        *group, *series, *order, micros(F.col(timestamp)).alias("_t"),
        F.col(timestamp).alias("match_time"), *values
    ).withColumn("_bucket", floor_to(F.col("_t"), tolerance))
    best = F.min(
        F.struct(F.abs(F.col("_t") - F.col("_p")).alias("gap"), "_t", *order, "match_time", *values)
    )
    matched = (
        timed.join(targets, [*group, "_bucket"])
        .where(F.abs(F.col("_t") - F.col("_p")) <= tolerance)
        .groupBy(*group, *series, "probe_time")
        .agg(best.alias("best"))
        .select(
            *group, *series, "probe_time", "best.match_time", *[f"best.{v}" for v in values]
        )
    )
    return (
        members.join(small, list(group))
        .join(matched, [*group, *series, "probe_time"], "left")
        .withColumn("has_data", F.col("match_time").isNotNull())
    )


def flag_extremes(
    matches: DataFrame, group: Sequence[str], series: str, value: str = "room_temp"
) -> DataFrame:
    """Marks the series with the highest and lowest ``value`` at each probe (ties: first name).

    The matches, one row per probe and series, are staged: the extremes and the rows both read them.
    """
    keys = [*group, "probe_time"]
    matches = stage(matches, "matches")
    extremes = (
        matches.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(F.struct((-F.col(value)).alias("rank"), series))[series].alias("_highest"),
            F.min(F.struct(F.col(value).alias("rank"), series))[series].alias("_lowest"),
        )
    )
    return (
        matches.join(extremes, keys, "left")
        .withColumns(
            {
                "is_max": F.coalesce(F.col(series) == F.col("_highest"), F.lit(False)),
                "is_min": F.coalesce(F.col(series) == F.col("_lowest"), F.lit(False)),
            }
        )
        .drop("_highest", "_lowest")
    )
