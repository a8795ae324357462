"""Time-series operators: smoothing, treatment runs, regimes, change events, regenerated clocks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.functions.columns import bin_start
from thermaline.functions.timebins import (
    MICROS_PER_DAY,
    MICROS_PER_MINUTE,
    duration_micros,
    floor_to,
    from_micros,
    micros,
)
from thermaline.operators.chunks import row_positions, series_of
from thermaline.staging import stage

# Start and step of the regenerated clock.
REGENERATED_START = datetime(2025, 12, 3, 11, 11, 0)
REGENERATED_STEP_MINUTES = 10

# Windows up to this length are frames over rows; wider ones are put together from sums of chunks this long.
WIDE_MICROS = MICROS_PER_DAY

# Rows without a time stand before all others, in a chunk of their own.
NO_TIME = "0001-01-01 00:00:00"


def smooth(
    df: DataFrame,
    columns: Sequence[str],
    window: str | None,
    keys: Sequence[str],
    timestamp: str = "timestamp",
) -> DataFrame:
    """Mean over ``(t - window, t]`` as ``<column>_smooth``; no window, no change.

    ``window`` is any positive duration (``30min``, ``3h``). A row without a time keeps NULL means. Each series is smoothed on its own. Rows go to the time chunk they lie in, and those of the last
    ``window`` of a chunk also to the next one, where they only feed the frame. Chunks are at least
    eight windows long, so at most about one row in eight is sent twice.

    Windows beyond ``WIDE_MICROS`` are summed from parts instead (:func:`_smooth_wide`), so that neither a task nor the
    work per row grows with them; ``df`` is read twice then, so stage an input that is costly to compute.
    """
    if window is None:
        return df
    span = duration_micros(window)
    present = [c for c in columns if c in df.columns]
    if span > WIDE_MICROS:
        return _smooth_wide(df, present, span, keys, timestamp)
    chunk = max(8 * span, MICROS_PER_DAY)
    timed = df.withColumn("_t", micros(F.col(timestamp))).withColumn(
        "_home", floor_to(F.col("_t"), chunk)
    )
    spread = timed.withColumn(
        "_chunk",
        F.explode(
            F.when(
                F.col("_t") - F.col("_home") > chunk - span,
                F.array(F.col("_home"), F.col("_home") + chunk),
            ).otherwise(F.array(F.col("_home")))
        ),
    )
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy("_t").rangeBetween(-(span - 1), 0)
    )
    return (
        spread.withColumns(
            {f"{c}_smooth": F.when(F.col("_t").isNotNull(), F.avg(c).over(frame)) for c in present}
        )
        .where(F.col("_chunk").eqNullSafe(F.col("_home")))
        .drop("_t", "_home", "_chunk")
    )


def _smooth_wide(
    df: DataFrame, columns: Sequence[str], span: int, keys: Sequence[str], timestamp: str, chunk: int = WIDE_MICROS
) -> DataFrame:
    """W1 for windows of at least a chunk: three sums, each over rows that are in the window.

    The window of a row at ``t`` is the rows of its own chunk up to ``t``, the chunks wholly inside, and the rows after
    ``t - window`` in the chunk where it begins. The first is a running sum. For the last, each row also visits that
    chunk as a question, and a running sum from the chunk's end answers it. The middle is a frame over a table of one
    row per chunk. No sum is taken from another, so digits aren't lost, and infinite values stay in their window.
    """
    steps = -(-span // chunk)  # chunks from the row's own back to the earliest in which its window can begin
    timed = df.withColumn("_t", micros(F.col(timestamp)))
    sums = [
        part
        for c in columns
        for part in (F.sum(c).alias(f"_{c}_sum"), F.count(c).alias(f"_{c}_n"))
    ]
    names = [f"_{c}_{kind}" for c in columns for kind in ("sum", "n")]

    own_frame = (
        Window.partitionBy(*keys, "_home").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    )
    placed = timed.where(F.col("_t").isNotNull()).withColumn("_home", floor_to(F.col("_t"), chunk))
    own = {}
    for c in columns:
        own[f"_{c}_sum_own"] = F.sum(c).over(own_frame)
        own[f"_{c}_n_own"] = F.count(c).over(own_frame)
    visits = placed.withColumns(own).withColumn("_row", F.struct("*"))
    begins = F.col("_t") - span
    visits = visits.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.inline(
            F.array(
                F.struct(
                    F.col("_home").alias("_chunk"),
                    F.col("_t").alias("_at"),
                    *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)],
                    F.lit(None).cast(visits.schema["_row"].dataType).alias("_row"),
                ),
                F.struct(
                    floor_to(begins, chunk).alias("_chunk"),
                    begins.alias("_at"),
                    *[F.lit(None).cast("double").alias(f"_v{i}") for i in range(len(columns))],
                    F.col("_row"),
                ),
            )
        ),
    )
    after = (
        Window.partitionBy(*[f"_key_{i}" for i in range(len(keys))], "_chunk")
        .orderBy(F.col("_at").desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    rest = {}
    for i, c in enumerate(columns):
        rest[f"_{c}_sum_rest"] = F.sum(f"_v{i}").over(after)
        rest[f"_{c}_n_rest"] = F.count(f"_v{i}").over(after)
    answered = (
        visits.withColumns(rest)
        .where(F.col("_row").isNotNull())
        .select("_row.*", F.col("_chunk").alias("_begin"), *rest)
    )

    # One row per chunk of a series; a chunk without rows has no row, and needs none.
    totals = placed.groupBy(*keys, "_home").agg(*sums).withColumn("_series", series_of(keys))
    along = Window.partitionBy("_series").orderBy("_home")
    between = {}
    for late in (0, 1):
        inside = steps - 1 - late
        for name in names:
            frame = along.rangeBetween(-inside * chunk, -chunk) if inside > 0 else None
            kind = totals.schema[name].dataType
            between[f"{name}_{late}"] = F.sum(name).over(frame) if frame else F.lit(None).cast(kind)
    middles = totals.withColumns(between).select("_series", "_home", *between)
    late = F.col("_begin") > F.col("_home") - steps * chunk

    def whole(name: str) -> Column:
        middle = F.when(late, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
        parts = [F.col(f"{name}_own"), middle, F.col(f"{name}_rest")]
        return sum((F.coalesce(part, F.lit(0)) for part in parts), F.lit(0))

    smoothed = answered.withColumn("_series", series_of(keys)).join(middles, ["_series", "_home"])
    done = smoothed.select(
        *df.columns, *[F.try_divide(whole(f"_{c}_sum"), whole(f"_{c}_n")).alias(f"{c}_smooth") for c in columns]
    )
    timeless = timed.where(F.col("_t").isNull()).select(
        *df.columns, *[F.lit(None).cast(done.schema[f"{c}_smooth"].dataType).alias(f"{c}_smooth") for c in columns]
    )
    return done.unionByName(timeless)


def _marked_runs(
    df: DataFrame, keys: Sequence[str], category: str, timestamp: str, chunk: str
) -> DataFrame:
    """W2 inside chunks: ``_run`` numbers the runs of equal values within (series, chunk)."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(timestamp)
    starts = (F.row_number().over(inside) == 1) | ~F.col(category).eqNullSafe(
        F.lag(category).over(inside)
    )
    return (
        df.withColumn("_at", F.coalesce(F.col(timestamp).cast("timestamp_ntz"), F.lit(NO_TIME).cast("timestamp_ntz")))
        .withColumn("_chunk", bin_start("_at", chunk))
        .drop("_at")
        .withColumn("_starts", starts.cast("int"))
        .withColumn("_run", F.sum("_starts").over(inside))
        .drop("_starts")
    )


def treatment_runs(
    df: DataFrame,
    keys: Sequence[str],
    category: str = "wall_type",
    timestamp: str = "timestamp",
    measures: Sequence[str] = (),
    chunk: str = "30 days",
) -> DataFrame:
    """W2 + W3: runs of equal treatment per series, cut at chunk borders, with their regime ids.

    ``changed`` is false on a run that carries on the regime of the chunk before. The first row of a
    series counts as a change. Runs are staged, since two passes read them.
    """
    marked = _marked_runs(df, keys, category, timestamp, chunk)
    return _numbered_runs(marked, keys, category, timestamp, measures)


def _numbered_runs(
    marked: DataFrame,
    keys: Sequence[str],
    category: str,
    timestamp: str,
    measures: Sequence[str] = (),
) -> DataFrame:
    """The runs of rows that :func:`_marked_runs` has marked, numbered across chunk borders."""
    runs = stage(
        marked.groupBy(*keys, "_chunk", "_run")
        .agg(
            F.any_value(category).alias(category),
            F.min(timestamp).alias("first_time"),
            F.max(timestamp).alias("last_time"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(m).alias(f"{m}_sum") for m in measures],
            *[F.count(m).alias(f"{m}_n") for m in measures],
        ),
        "runs",
    )
    runs = runs.withColumn("_series", series_of(keys))
    chunks = runs.groupBy("_series", "_chunk").agg(
        F.min_by(category, "_run").alias("_first"),
        F.max_by(category, "_run").alias("_last"),
        F.count(F.lit(1)).alias("_runs"),
    )
    along = Window.partitionBy("_series").orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    links = (
        chunks.withColumn(
            "_joined",
            (
                F.lag("_chunk").over(along).isNotNull()
                & F.col("_first").eqNullSafe(F.lag("_last").over(along))
            ).cast("int"),
        )
        .withColumn(
            "_offset",
            F.coalesce(F.sum(F.col("_runs") - F.col("_joined")).over(before), F.lit(0))
            - F.col("_joined"),
        )
        .select("_series", "_chunk", "_joined", "_offset")
    )
    return (
        runs.join(links, ["_series", "_chunk"])
        .withColumn("regime_id", F.col("_offset") + F.col("_run"))
        .withColumn("changed", ~((F.col("_run") == 1) & (F.col("_joined") == 1)))
        .drop("_series", "_joined", "_offset")
    )


def change_events(
    df: DataFrame,
    keys: Sequence[str],
    category: str = "wall_type",
    timestamp: str = "timestamp",
    chunk: str = "30 days",
) -> DataFrame:
    """Time and new value of each transition, per series."""
    runs = treatment_runs(df, keys, category, timestamp, chunk=chunk)
    return runs.where("changed").select(*keys, F.col("first_time").alias(timestamp), category)


def with_regimes(
    df: DataFrame,
    keys: Sequence[str],
    category: str = "wall_type",
    timestamp: str = "timestamp",
    chunk: str = "30 days",
) -> DataFrame:
    """``regime_id`` on every row, 1..k along each series."""
    marked = stage(_marked_runs(df, keys, category, timestamp, chunk), "marked-runs")
    regimes = _numbered_runs(marked, keys, category, timestamp).select(
        series_of(keys).alias("_series"), "_chunk", "_run", "regime_id"
    )
    return (
        marked.withColumn("_series", series_of(keys))
        .join(regimes, ["_series", "_chunk", "_run"])
        .drop("_series", "_chunk", "_run")
    )


def regime_summary(wall: DataFrame, box_id: int = 2, chunk: str = "30 days") -> DataFrame:
    """Per (period, wall, treatment, regime) of one box: time span, rows and mean measures."""
    measures = [c for c in wall.columns if c.endswith(("_surface", "_internal", "_gradient"))]
    keys = ["period", "wall_id"]
    runs = treatment_runs(
        wall.where(F.col("box_id") == box_id), keys, measures=measures, chunk=chunk
    )
    return runs.groupBy(*keys, "wall_type", "regime_id").agg(
        F.min("first_time").alias("timestamp_min"),
        F.max("last_time").alias("timestamp_max"),
        F.sum("n").alias("timestamp_count"),
        *[
            F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(f"{m}_mean")
            for m in measures
        ],
    )


def regenerate_timestamps(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    start: datetime = REGENERATED_START,
    step_minutes: int = REGENERATED_STEP_MINUTES,
) -> DataFrame:
    """Row i of a file, in file order, gets ``start + i * step``.

    ``chunk`` is a column that never decreases along ``order`` (a file block, a range of row ids).
    """
    positioned = row_positions(df, keys, order, chunk)
    begin = micros(F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
    step = step_minutes * MICROS_PER_MINUTE
    return positioned.withColumn("timestamp", from_micros(begin + F.col("row_index") * step))
