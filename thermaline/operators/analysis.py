"""Data behind the charts and tables of the experiment."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.functions.columns import box_name, measure, round_half_even
from thermaline.operators.lag import thermal_lag
from thermaline.operators.selection import in_box, in_periods, with_wall_type
from thermaline.schema import BOX_KEYS, BOX_NAMES


def gradient_by_type(wall: DataFrame, periods: Sequence[str] | None = None) -> DataFrame:
    """A8 + F8 + O2: mean profile and the two key gradients per treatment, ordered by the total."""
    parts = ["room_temp", "out_surface", "in_surface", "in_internal"]
    return (
        with_wall_type(in_periods(wall, periods))
        .groupBy("wall_type")
        .agg(*[F.avg(c).alias(c) for c in parts])
        .dropna(subset=parts)
        .withColumns(
            {
                "surface_gradient": F.col("out_surface") - F.col("in_surface"),
                "total_gradient": F.col("room_temp") - F.col("in_internal"),
            }
        )
        .orderBy("total_gradient")
    )


def profile_by_type(
    wall: DataFrame, box_id: int = 2, walls: Sequence[int] | None = None
) -> DataFrame:
    """Outside and inside surface per treatment and time, averaged over walls."""
    return (
        with_wall_type(in_box(wall, box_id, walls))
        .groupBy("wall_type", "timestamp")
        .agg(F.avg("out_surface").alias("out_surface"), F.avg("in_surface").alias("in_surface"))
    )


def lag_by_type(wall: DataFrame, box_id: int = 2, **options) -> DataFrame:
    """W5 on A9: thermal lag of each treatment."""
    return thermal_lag(profile_by_type(wall, box_id), ["wall_type"], **options)


def delta_series(
    wall: DataFrame, periods: Sequence[str] | None = None, normalized: bool = False
) -> DataFrame:
    """A10 + P9: surface and total delta per treatment and time, raw or relative to the room."""
    averaged = (
        with_wall_type(in_periods(wall, periods))
        .groupBy("wall_type", "timestamp")
        .agg(
            F.avg(measure(wall, "out_surface", normalized)).alias("out_surface"),
            F.avg(measure(wall, "in_surface", normalized)).alias("in_surface"),
            F.avg(measure(wall, "in_internal", normalized)).alias("in_internal"),
            F.avg("room_temp").alias("room_temp"),
        )
    )
    room = F.lit(0.0) if normalized else F.col("room_temp")
    return averaged.select(
        "wall_type",
        "timestamp",
        (F.col("out_surface") - F.col("in_surface")).alias("surface_delta"),
        (room - F.col("in_internal")).alias("total_delta"),
    )


def relationship(
    wall: DataFrame,
    x: str = "room_temp",
    y: str = "in_internal",
    periods: Sequence[str] | None = None,
    normalized: bool = False,
) -> DataFrame:
    """A11 + P11: mean y and number of rows per treatment and x rounded to 0.1.

    x and y are ``room_temp``, ``out_surface``, ``in_surface`` or ``in_internal``. In the normalized
    view the room on the x axis is the constant 0; on the y axis it stays as measured.
    """

    def pick(name: str) -> Column:
        return F.col(name) if name == "room_temp" else measure(wall, name, normalized)

    binned = F.lit(0.0) if normalized and x == "room_temp" else round_half_even(pick(x), 1)
    return (
        with_wall_type(in_periods(wall, periods))
        .select("wall_type", binned.alias("x_binned"), pick(y).alias("y"), "timestamp")
        .where(F.col("x_binned").isNotNull())
        .groupBy("wall_type", "x_binned")
        .agg(F.avg("y").alias("y_mean"), F.count("timestamp").alias("n"))
    )


def correlation(a: str, b: str) -> Column:
    """Pearson over rows where both are present; NULL when either is constant there."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(box: DataFrame) -> DataFrame:
    """Correlation of internal, room and surface temperatures of both boxes, one row per cell.

    The room is the same for both boxes, so only the first box's is kept. All pairs come from one
    aggregate over one row per time.
    """
    columns = {
        f"{name}_{base}": F.avg(F.when(F.col("box_id") == box_id, F.col(f"{base}_temp")))
        for base in ("internal", "room", "surface")
        for box_id, name in BOX_NAMES.items()
        if not (base == "room" and box_id != min(BOX_NAMES))
    }
    by_time = box.groupBy("timestamp").agg(*[c.alias(n) for n, c in columns.items()])
    names = list(columns)
    pairs = list(combinations(names, 2))
    cells = by_time.agg(
        *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs],
        *[
            F.when(F.stddev_pop(n) > 0, F.lit(1.0)).alias(f"{n}|{n}")
            for n in names
        ],
    )
    entries = [(a, b, f"{a}|{b}") for a, b in pairs]
    entries += [(b, a, name) for a, b, name in entries]
    entries += [(n, n, f"{n}|{n}") for n in names]
    return cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("row_name"),
                        F.lit(b).alias("column_name"),
                        F.col(f"`{name}`").alias("r"),
                    )
                    for a, b, name in entries
                ]
            )
        )
    )


def summary_table(wall: DataFrame) -> DataFrame:
    """Mean and sample deviation per (period, treatment), rounded to two places."""
    measures = [
        "out_normalized_internal",
        "in_normalized_internal",
        "surface_gradient",
        "internal_gradient",
    ]
    return (
        with_wall_type(wall)
        .groupBy("period", "wall_type")
        .agg(
            *[round_half_even(F.avg(m), 2).alias(f"{m}_mean") for m in measures],
            *[round_half_even(F.stddev_samp(m), 2).alias(f"{m}_std") for m in measures],
        )
    )


def room_mean(box: DataFrame) -> DataFrame:
    """Room temperature per time, averaged over boxes."""
    return box.groupBy("timestamp").agg(F.avg("room_temp").alias("room_temp"))


def wall_internal_mean(
    wall: DataFrame, box_id: int, walls: Sequence[int] | None = None, smoothed: bool = False
) -> DataFrame:
    """Inside-sensor internal temperature per time, averaged over the chosen walls."""
    column = measure(wall, "in_internal", smoothed=smoothed)
    return (
        in_box(wall, box_id, walls).groupBy("timestamp").agg(F.avg(column).alias("in_internal"))
    )


def box_detail_profile(sensor: DataFrame, normalized: bool = False) -> DataFrame:
    """Internal, inside surface, outside surface and room per (period, box, time).

    The outside surface is the mean of wall means, the rest are means over sensors. Wall sums feed the
    box sums, so both come from one pass over the clustered sensor level.
    """
    internal = measure(sensor, "internal_temp", normalized)
    surface = measure(sensor, "surface_temp", normalized)
    inside = F.when(F.col("position") == "in", surface)
    outside = F.when(F.col("position") == "out", surface)
    sums = {"internal": internal, "inside_surface": inside, "room": F.col("room_temp")}
    per_wall = sensor.groupBy(*BOX_KEYS, "wall_id").agg(
        *[F.sum(c).alias(f"{n}_sum") for n, c in sums.items()],
        *[F.count(c).alias(f"{n}_n") for n, c in sums.items()],
        F.avg(outside).alias("outside"),
    )

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))

    return per_wall.groupBy(*BOX_KEYS).agg(
        mean("internal").alias("internal"),
        mean("inside_surface").alias("inside_surface"),
        F.avg("outside").alias("outside_surface"),
        (F.lit(0.0) if normalized else mean("room")).alias("room"),
    )


def sensor_vs_box_mean(sensor: DataFrame, y: str = "internal_temp") -> DataFrame:
    """Each sensor's value next to the mean of all given sensors of its box at that time."""
    together = Window.partitionBy(*BOX_KEYS)
    return (
        sensor.select(*BOX_KEYS, "sensor_id", "position", F.col(y).alias("value"))
        .withColumn("box_mean", F.avg("value").over(together))
        .withColumn("deviation", F.col("value") - F.col("box_mean"))
    )


def wall_comparison(
    wall: DataFrame, normalized: bool = False, smoothed: bool = False
) -> DataFrame:
    """The same wall of both boxes side by side per time."""
    bases = {"internal": "in_internal", "surface": "in_surface", "out_surface": "out_surface"}
    return wall.groupBy("period", "wall_id", "timestamp").agg(
        *[
            F.avg(
                F.when(F.col("box_id") == box_id, measure(wall, base, normalized, smoothed))
            ).alias(f"{name.lower()}_{label}")
            for box_id, name in BOX_NAMES.items()
            for label, base in bases.items()
        ]
    )


def box_timeline(box: DataFrame, normalized: bool = False, smoothed: bool = False) -> DataFrame:
    """P8 + P12: labelled internal and surface lines of each box."""
    return box.select(
        "period",
        "timestamp",
        "box_id",
        box_name(F.col("box_id")).alias("box_name"),
        measure(box, "internal_temp", normalized, smoothed).alias("internal"),
        measure(box, "surface_temp", normalized, smoothed).alias("surface"),
    )


def wall_timeline(
    wall: DataFrame, box_id: int, walls: Sequence[int] | None = None, smoothed: bool = False
) -> DataFrame:
    """P8 + F5: surface lines of the chosen walls of one box."""
    return in_box(wall, box_id, walls).select(
        "period",
        "timestamp",
        "wall_id",
        measure(wall, "in_surface", smoothed=smoothed).alias("in_surface"),
        measure(wall, "out_surface", smoothed=smoothed).alias("out_surface"),
    )
