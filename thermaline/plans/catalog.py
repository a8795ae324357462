"""Registered queries: every operator on the driver's ``events`` table, whole.

Doubles are compared at nine places (see :func:`comparable`). Level queries that need outside and inside sensors
to meet in a bin use six-hour bins; the rest use the ten-minute bins of the experiment.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.functions.timebins import floor_to, format_logger_time
from thermaline.operators import analysis, audit, curate, levels, nearest, selection, series
from thermaline.plans.flows import Levels, answer, build_levels, curate_folder, load_curated
from thermaline.schema import BOX_KEYS, BOX_SMOOTHED, MEASURES, SERIES_KEYS, WALL_SMOOTHED
from thermaline.sources import logger_files, sinks
from thermaline.sources.events import dirty_logger_rows, logger_slices, readings_from_events
from thermaline.staging import staging_path

WIDTH = "6 hours"
TOLERANCE_MINUTES = 60
BOX_SERIES = ["period", "box_id"]
WALL_SERIES = ["period", "box_id", "wall_id"]

# Period ranges that cut the month of the events as the experiment's ranges cut its files.
EVENT_PERIODS = [
    ("Period1", datetime(2024, 1, 1, 0, 0, 0), datetime(2024, 1, 11, 23, 59, 59)),
    ("Period2", datetime(2024, 1, 18, 11, 0, 0), datetime(2024, 1, 26, 11, 59, 59)),
]

# Sensors taken out in the exclusion queries.
EXCLUDED_PAIRS = [(1, 3), (2, 9), (2, 10)]

Query = Callable[[SparkSession, str], DataFrame]


# Fixed value: means of two-place numbers often end exactly half way at the tenth place, where the last
# bit of a sum decides the rounding. This shift, the same in the oracle, moves them off the half.
TIE_SHIFT = 3.7e-11


def comparable(df: DataFrame) -> DataFrame:
    """Doubles at nine decimals, without negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{name}`") + TIE_SHIFT, 9) + F.lit(0.0)).alias(name)
            if kind == "double"
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def on_readings(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(build(readings_from_events(spark, sf_dir)))


def on_levels(build: Callable[[Levels], DataFrame], width: str = WIDTH) -> Query:
    return on_readings(lambda readings: build(build_levels(readings, width)))


def _probe_matches(readings: DataFrame) -> DataFrame:
    matches = nearest.nearest_in_time(
        nearest.noon_probes(readings, ["period"]),
        readings,
        ["period"],
        ["file"],
        [*MEASURES, "wall_type"],
        TOLERANCE_MINUTES,
        ["file_order"],
    )
    return nearest.flag_extremes(matches, ["period"], "file")


def _regenerated(readings: DataFrame) -> DataFrame:
    rows = series.regenerate_timestamps(
        readings.select("period", "file", "file_order", *MEASURES),
        ["period", "file"],
        ["file_order"],
        floor_to(F.col("file_order"), 1 << 20),
    )
    return rows.withColumn("date_text", format_logger_time(F.col("timestamp")))


def _repaired(readings: DataFrame) -> DataFrame:
    return curate.repair_clocks(
        readings.select("file", "file_order", "internal_temp"),
        ["file_order"],
        floor_to(F.col("file_order"), 1 << 20),
        [name.replace("GW", "GW_") for name in curate.FILES_TO_REPAIR],
    )


def _drop(spark: SparkSession, readings: DataFrame, path: str, empty_file: bool = False) -> str:
    """The readings as a folder of logger files below ``path``; on demand with one of zero length."""
    sinks.write_logger_text(dirty_logger_rows(readings), path)
    if empty_file:
        nothing = spark.createDataFrame([], "value string").coalesce(1)
        nothing.write.text(f"{path}/folder=Period1/file=GW_1.1_empty.csv")
    return path


def _ingested(
    spark: SparkSession, sf_dir: str, mode: str = logger_files.LOAD, empty_file: bool = False
) -> logger_files.LoggerFiles:
    path = _drop(spark, readings_from_events(spark, sf_dir), staging_path(spark, "logger"), empty_file)
    return logger_files.load_logger_files(spark, path, "*.txt", folders=True, mode=mode)


def _logger_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(logger_files.readings_only(_ingested(spark, sf_dir)))


def _logger_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).files.drop("path")


def _logger_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logger_files.load_summary(_ingested(spark, sf_dir, empty_file=True).files)


def _audit_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(logger_files.readings_only(_ingested(spark, sf_dir, logger_files.AUDIT)))


def _audit_file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _ingested(spark, sf_dir, logger_files.AUDIT, empty_file=True)
    return audit.file_profile(loaded.readings, loaded.files)


def _curated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop, target = staging_path(spark, "drop"), staging_path(spark, "curation")
    _drop(spark, readings_from_events(spark, sf_dir), drop)
    curate_folder(spark, drop, target, EVENT_PERIODS, "*.txt", folders=True)
    box = load_curated(spark, target, WIDTH).box
    return comparable(box.select("period", "box_id", "timestamp", "sensor_count", "internal_temp"))


def _quarantine_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine after two runs into one target, the second over the first box only."""
    readings, target = readings_from_events(spark, sf_dir), staging_path(spark, "curation")
    for part in (readings, readings.where("box_id = 1")):
        drop = _drop(spark, part, staging_path(spark, "drop"))
        curate_folder(spark, drop, target, EVENT_PERIODS, "*.txt", folders=True)
    held = sinks.read_quarantine(spark, target)
    return held.groupBy("status", "source_period", "file", "reason").agg(F.count("*").alias("n_lines"))


def _without_a_box(readings: DataFrame) -> DataFrame:
    return readings.where("not (period = 'Period2' and box_id = 2)")


def _twenty_sensors(readings: DataFrame) -> DataFrame:
    """Ids up to 20, four of them beyond the expected ones."""
    number = F.shiftright("file_order", 1) % 20 + 1
    return readings.where("sensor_id <> 3").withColumn("sensor_id", number.cast("int"))


def _verdicts(readings: DataFrame) -> DataFrame:
    return curate.file_verdicts(logger_slices(readings), EVENT_PERIODS)


def _judged(readings: DataFrame) -> DataFrame:
    rows = logger_slices(readings).select(
        "source_period", "file", "file_order", "timestamp", *MEASURES
    )
    return curate.judged_rows(rows, curate.file_verdicts(rows, EVENT_PERIODS))


def _curated_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.curated_rows(_judged(readings_from_events(spark, sf_dir)), EVENT_PERIODS)
    base = staging_path(spark, "curation")
    sinks.write_curated(rows, base)
    again = selection.in_period(sinks.read_curated(spark, base), "Period2")
    return comparable(again.select("period", "file", "file_order", "timestamp", *MEASURES))


def _export_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = build_levels(readings_from_events(spark, sf_dir), WIDTH).box
    ordered = box.select("period", "box_id", "timestamp", "internal_temp", "sensor_count")
    path = sinks.export_level(
        selection.in_period(ordered, "Period1"), staging_path(spark, "export"), "Box", "Period1"
    )
    schema = "period string, box_id int, timestamp timestamp_ntz, internal_temp double, sensor_count bigint"
    return comparable(spark.read.csv(path, header=True, schema=schema))


def _smoothed_answer(levels_: Levels) -> DataFrame:
    shown = answer(levels_, "Period2", EXCLUDED_PAIRS, "3h")
    return analysis.box_timeline(shown.box, normalized=True, smoothed=True)


def _smoothed_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, "timestamp", *[f"{c}_smooth" for c in columns])


def _smooth_box(window: str) -> Query:
    return on_levels(
        lambda lv: _smoothed_columns(
            series.smooth(lv.box, BOX_SMOOTHED, window, BOX_SERIES), BOX_SERIES, BOX_SMOOTHED
        ),
        "10 minutes",
    )


def registered() -> dict[str, Query]:
    return {
        # levels
        "resample_10min": on_readings(lambda r: levels.with_topology(levels.resample(r))),
        "modal_value": on_readings(
            lambda r: levels.modal_value(
                r.withColumn("day", F.col("timestamp").cast("date")),
                [*SERIES_KEYS, "day"],
                "label",
            )
        ),
        "bin_completeness": on_levels(lambda lv: levels.bin_completeness(lv.sensor), "10 minutes"),
        "bin_count_histogram": on_levels(
            lambda lv: levels.bin_count_histogram(levels.bin_completeness(lv.sensor)),
            "10 minutes",
        ),
        "incomplete_bins_first": on_levels(
            lambda lv: levels.incomplete_bins(levels.bin_completeness(lv.sensor)), "10 minutes"
        ),
        "normalized_temps": on_levels(lambda lv: lv.sensor, "10 minutes"),
        "wall_level": on_levels(lambda lv: lv.wall),
        "box_level": on_levels(lambda lv: lv.box),
        # analysis
        "gradient_by_type": on_levels(lambda lv: analysis.gradient_by_type(lv.wall)),
        "profile_by_type": on_levels(lambda lv: analysis.profile_by_type(lv.wall)),
        "delta_series": on_levels(lambda lv: analysis.delta_series(lv.wall)),
        "delta_series_normalized": on_levels(
            lambda lv: analysis.delta_series(lv.wall, ["Period1"], normalized=True)
        ),
        "relationship_binned": on_levels(lambda lv: analysis.relationship(lv.wall)),
        "relationship_binned_normalized": on_levels(
            lambda lv: analysis.relationship(lv.wall, "out_surface", "in_internal", normalized=True)
        ),
        "relationship_room_zero": on_levels(
            lambda lv: analysis.relationship(lv.wall, "room_temp", "in_surface", normalized=True)
        ),
        "correlation_matrix": on_levels(lambda lv: analysis.correlation_matrix(lv.box)),
        "summary_table": on_levels(lambda lv: analysis.summary_table(lv.wall)),
        "room_mean": on_levels(lambda lv: analysis.room_mean(lv.box), "10 minutes"),
        "wall_internal_mean": on_levels(
            lambda lv: analysis.wall_internal_mean(lv.wall, 2, [1, 2, 4])
        ),
        "box_detail_profile": on_levels(lambda lv: analysis.box_detail_profile(lv.sensor)),
        "box_detail_profile_normalized": on_levels(
            lambda lv: analysis.box_detail_profile(lv.sensor, normalized=True)
        ),
        "sensor_vs_box_mean": on_levels(
            lambda lv: analysis.sensor_vs_box_mean(
                selection.in_box(lv.sensor, 1, sensors=[1, 2, 5, 9, 12])
            )
        ),
        "wall_comparison": on_levels(lambda lv: analysis.wall_comparison(lv.wall)),
        "box_timeline": on_levels(lambda lv: analysis.box_timeline(lv.box)),
        "wall_timeline": on_levels(lambda lv: analysis.wall_timeline(lv.wall, 2, [1, 3])),
        # series
        "smooth_30min": _smooth_box("30min"),
        "smooth_1h": _smooth_box("1h"),
        "smooth_3h": _smooth_box("3h"),
        "smooth_12h": _smooth_box("12h"),
        "smooth_30d": _smooth_box("30d"),
        "smooth_walls_12h": on_levels(
            lambda lv: _smoothed_columns(
                series.smooth(lv.wall, WALL_SMOOTHED, "12h", WALL_SERIES),
                WALL_SERIES,
                WALL_SMOOTHED,
            )
        ),
        "change_events": on_levels(lambda lv: series.change_events(lv.wall, WALL_SERIES)),
        "regimes": on_levels(
            lambda lv: series.with_regimes(
                lv.wall.select(*WALL_SERIES, "timestamp", "wall_type"), WALL_SERIES
            )
        ),
        "regime_summary": on_levels(lambda lv: series.regime_summary(lv.wall)),
        "thermal_lag": on_levels(lambda lv: analysis.lag_by_type(lv.wall)),
        "noon_probes": on_readings(lambda r: nearest.noon_probes(r, ["period"])),
        "noon_probes_first_days": on_readings(
            lambda r: nearest.first_days(nearest.noon_probes(r))
        ),
        "nearest_probe": on_readings(_probe_matches),
        "regenerated_timestamps": on_readings(_regenerated),
        "repaired_clocks": on_readings(_repaired),
        # filters and joins
        "topology_lookup": on_readings(
            lambda r: levels.with_topology(r.select("file", "file_order", "box_id", "sensor_id"))
        ),
        "period_filter": on_levels(lambda lv: selection.in_period(lv.box, "Period2")),
        "range_filter": on_readings(
            lambda r: selection.in_period_range(
                r.select("period", "file", "file_order", "timestamp", *MEASURES), EVENT_PERIODS
            )
        ),
        "wall_type_choices": on_readings(lambda r: selection.distinct_values(r, "wall_type")),
        "exclude_sensors_wall": on_levels(lambda lv: answer(lv, excluded=EXCLUDED_PAIRS).wall),
        "exclude_sensors_box": on_levels(lambda lv: answer(lv, excluded=EXCLUDED_PAIRS).box),
        "answer_smoothed": on_levels(_smoothed_answer, "10 minutes"),
        "missing_sensors": on_readings(audit.missing_sensors),
        "missing_sensors_absent_box": on_readings(lambda r: audit.missing_sensors(_without_a_box(r))),
        "missing_sensors_by_bin": on_levels(
            lambda lv: audit.missing_sensors(lv.sensor, BOX_KEYS), "10 minutes"
        ),
        "missing_sensors_on_grid": on_levels(
            lambda lv: audit.missing_sensors_on_grid(lv.sensor, "10 minutes", EVENT_PERIODS), "10 minutes"
        ),
        # audits
        "missing_profile": on_readings(audit.missing_profile),
        "missing_by_column": on_readings(audit.missing_by_column),
        "rows_with_missing": on_readings(audit.rows_with_missing),
        "type_distribution": on_readings(audit.type_distribution),
        "sensor_mapping": on_readings(audit.sensor_mapping),
        "sensor_availability": on_readings(
            lambda r: audit.sensor_availability(
                r.withColumn("day", F.col("timestamp").cast("date")), ["period", "box_id", "day"]
            )
        ),
        "sensor_availability_wide": on_readings(lambda r: audit.sensor_availability(_twenty_sensors(r))),
        "coverage": on_readings(audit.coverage),
        "period_summary": on_readings(audit.period_summary),
        "sensor_summary": on_readings(audit.sensor_summary),
        "file_profile": on_readings(audit.file_profile),
        "range_check": on_readings(lambda r: audit.range_check(logger_slices(r), EVENT_PERIODS)),
        "valid_rollup": on_readings(lambda r: audit.valid_rollup(r, EVENT_PERIODS)),
        "valid_rollup_absent_box": on_readings(
            lambda r: audit.valid_rollup(_without_a_box(r), EVENT_PERIODS)
        ),
        "rows_per_day": on_readings(audit.rows_per_day),
        "audit_report": on_readings(audit.audit_report),
        "readiness": on_readings(audit.readiness),
        "range_audit": on_readings(lambda r: audit.range_audit(r, EVENT_PERIODS)),
        "missing_times": on_readings(lambda r: audit.missing_times(r, EVENT_PERIODS)),
        "first_readings": on_readings(audit.first_readings),
        "overview": on_levels(
            lambda lv: audit.overview(lv.sensor), "10 minutes"
        ),
        # ingest, curation, sinks
        "logger_ingest": _logger_ingest,
        "logger_file_status": _logger_file_status,
        "logger_load_summary": _logger_load_summary,
        "audit_ingest": _audit_ingest,
        "audit_file_profile": _audit_file_profile,
        "curated_levels": _curated_levels,
        "quarantine_reload": _quarantine_reload,
        "curation_verdicts": on_readings(_verdicts),
        "curation_totals": on_readings(lambda r: curate.curation_totals(_verdicts(r))),
        "curated_rows": on_readings(
            lambda r: curate.curated_rows(_judged(r), EVENT_PERIODS)
        ),
        "quarantined_rows": on_readings(
            lambda r: curate.quarantined_rows(_judged(r))
        ),
        "curated_reload": _curated_reload,
        "export_reload": _export_reload,
    }
