"""The three levels: sensor (binned), wall (outside / inside) and box.

Exchanges: one after the map-side combine of the raw readings, and one by ``(period, box_id,
timestamp)``. Wall and box level group by supersets of these columns, so they need no further one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.functions.columns import bin_start, normalized_columns, with_gradients
from thermaline.schema import (
    BOX_KEYS,
    MEASURES,
    READINGS_PER_BIN,
    SERIES_KEYS,
    WALL_KEYS,
    topology,
)


def modal_value(
    df: DataFrame, keys: Sequence[str], category: str, alias: str | None = None
) -> DataFrame:
    """A2: most frequent value per group, ties to the smallest, NULLs ignored.

    Counts per (keys, value) combine before the shuffle, so a hot group costs one row per task.
    """
    counted = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(_most_frequent(F.col(category), "n").alias(alias or category))


def _most_frequent(category: Column, count: str) -> Column:
    """The value with the highest count, the smallest of several; NULL values do not take part."""
    candidate = F.when(
        category.isNotNull(), F.struct((-F.col(count)).alias("rank"), category.alias("value"))
    )
    return F.min(candidate)["value"]


def resample(
    readings: DataFrame,
    width: str = "10 minutes",
    keys: Sequence[str] = tuple(SERIES_KEYS),
    measures: Sequence[str] = tuple(MEASURES),
    category: str = "wall_type",
    cluster_by: Sequence[str] = tuple(BOX_KEYS),
) -> DataFrame:
    """A1: mean of each measure and the modal category per series and calendar bin.

    Sums and counts per (series, bin, category) are hash-aggregated on the map side first; the second,
    small step picks the mode. Its rows are clustered by ``cluster_by`` for the levels above.
    """
    binned = readings.select(
        *keys, bin_start("timestamp", width).alias("timestamp"), *measures, category
    )
    partial = binned.groupBy(*keys, "timestamp", category).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(f"{m}_sum") for m in measures],
        *[F.count(m).alias(f"{m}_n") for m in measures],
    )
    return (
        partial.repartition(*cluster_by)
        .groupBy(*keys, "timestamp")
        .agg(
            *[F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(m) for m in measures],
            _most_frequent(F.col(category), "n").alias(category),
        )
    )


def normalize(sensor: DataFrame) -> DataFrame:
    """P5 on a frame with raw temperatures."""
    return sensor.withColumns(normalized_columns())


def with_topology(df: DataFrame) -> DataFrame:
    """Wall and position of each sensor; unknown sensors keep NULLs."""
    return df.drop("wall_id", "position").join(topology(df.sparkSession), "sensor_id", "left")


def sensor_level(readings: DataFrame, width: str = "10 minutes") -> DataFrame:
    """A1 + P5 + J1: one row per (period, box, sensor, bin).

    Wall and position follow from the sensor, so they are looked up after the binning, on fewer rows.
    """
    return normalize(with_topology(resample(readings, width)))


def wall_level(sensor: DataFrame) -> DataFrame:
    """A4 + A5 + P6 + P7: one row per (period, box, wall, bin) with out_/in_ columns.

    Presence of a side decides, not NULL values: the room comes from 'out' when that side has any
    row, else from 'in'; the treatment from 'in' when present, else from 'out'. Sensors without a
    wall are left out here only. Sums per (wall, side, treatment) are hash-aggregated first and then
    folded into one row; the sensor level is clustered so that neither step moves a row.
    """
    quantities = {
        "surface_temp": "surface",
        "internal_temp": "internal",
        "room_temp": "room",
        "normalized_surface": "normalized_surface",
        "normalized_internal": "normalized_internal",
    }
    per_type = (
        sensor.dropna(subset=WALL_KEYS)
        .groupBy(*WALL_KEYS, "position", "wall_type")
        .agg(
            F.count("sensor_id").alias("n"),
            *[F.sum(c).alias(f"{c}_sum") for c in quantities],
            *[F.count(c).alias(f"{c}_n") for c in quantities],
        )
    )
    aggregates = []
    for position in ("out", "in"):

        def side(column: str, position: str = position) -> Column:
            return F.when(F.col("position") == position, F.col(column))

        typed = side("wall_type")
        aggregates += [
            F.try_divide(F.sum(side(f"{c}_sum")), F.sum(side(f"{c}_n"))).alias(
                f"{position}_{name}"
            )
            for c, name in quantities.items()
        ]
        aggregates += [
            F.sum(side("n")).alias(f"{position}_sensor_count"),
            _most_frequent(typed, "n").alias(f"{position}_type"),
        ]
    rolled = per_type.groupBy(*WALL_KEYS).agg(*aggregates)
    has_out = F.col("out_sensor_count").isNotNull()
    has_in = F.col("in_sensor_count").isNotNull()
    picked = rolled.withColumns(
        {
            "wall_type": F.when(has_in, F.col("in_type")).otherwise(F.col("out_type")),
            "room_temp": F.when(has_out, F.col("out_room")).otherwise(F.col("in_room")),
        }
    ).drop("in_type", "out_type")
    return with_gradients(picked)


def box_level(sensor: DataFrame) -> DataFrame:
    """A6 (with J2 folded in): box means; surface values come from inside sensors only."""
    inside = F.col("position") == "in"
    return sensor.groupBy(*BOX_KEYS).agg(
        F.avg("internal_temp").alias("internal_temp"),
        F.avg("room_temp").alias("room_temp"),
        F.count("sensor_id").alias("sensor_count"),
        F.avg("normalized_internal").alias("normalized_internal"),
        F.avg(F.when(inside, F.col("surface_temp"))).alias("surface_temp"),
        F.avg(F.when(inside, F.col("normalized_surface"))).alias("normalized_surface"),
    )


def bin_completeness(sensor: DataFrame, expected: int = READINGS_PER_BIN) -> DataFrame:
    """A3: series per (period, bin) against the expected number."""
    return (
        sensor.groupBy("period", "timestamp")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .withColumn("complete", F.col("n_values") == expected)
    )


def bin_count_histogram(completeness: DataFrame) -> DataFrame:
    """How many bins have how many series."""
    return completeness.groupBy("period", "n_values").agg(F.count(F.lit(1)).alias("n_bins"))


def incomplete_bins(completeness: DataFrame, limit: int = 10) -> DataFrame:
    """The first bad bins, as the report shows them."""
    return completeness.where(~F.col("complete")).orderBy("period", "timestamp").limit(limit)
