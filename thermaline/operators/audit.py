"""Reports on the data itself.

Most reports start from one table with a row per (period, file, box, sensor), built by a single
map-side combined pass over the readings; everything above it is a roll-up of that table. Sensor
lists are bit masks until the end, so that sets are merged by hash aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.functions.columns import bin_start, box_name
from thermaline.functions.timebins import to_seconds_text, whole_days
from thermaline.operators.levels import with_topology
from thermaline.operators.selection import with_range_flag
from thermaline.schema import (
    BOX_KEYS,
    BOX_NAMES,
    MEASURES,
    PERIODS,
    READINGS_PER_DAY,
    SENSORS_PER_BOX,
    SENSORS_PER_WALL,
    WALL_SENSORS,
    periods_table,
    small_table,
)
from thermaline.staging import stage

# Report thresholds and list lengths.
MAX_LISTED_INVALID = 10
MAX_LISTED_MISSING = 7
LOW_ROW_COUNT = 5
TYPE_LIST_WIDTH = 28
TYPE_LIST_CUT = 25

# Reasons that make a file FAILED; other reasons make it an ERROR.
FAILED_REASONS = ["no header", "no date column", "empty file"]

FILE_KEYS = ["period", "file", "box_id", "sensor_id"]
CHECKED = [*MEASURES, "wall_type"]


def _bit(sensor: Column) -> Column:
    expected = sensor.between(1, SENSORS_PER_BOX)
    one = F.lit(1).cast("bigint")
    return F.when(expected, F.call_function("shiftleft", one, sensor.cast("int")))


def _sensors_in(mask: Column, present: bool = True) -> Column:
    every = F.sequence(F.lit(1), F.lit(SENSORS_PER_BOX))
    bits = F.coalesce(mask, F.lit(0).cast("bigint"))
    return F.filter(
        every, lambda s: (F.getbit(bits, s) == 1) if present else (F.getbit(bits, s) == 0)
    )


def _expected_boxes(df: DataFrame, walls: bool = False) -> DataFrame:
    """The boxes (and their walls, NULL for the whole box) that each expected period should hold."""
    below = [None, *WALL_SENSORS] if walls else [None]
    rows = [(name, box, wall) for name, *_ in PERIODS for box in BOX_NAMES for wall in below]
    table = small_table(df.sparkSession, rows, "period string, box_id int, wall_id int")
    return table if walls else table.drop("wall_id")


def _missing(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def file_table(readings: DataFrame) -> DataFrame:
    """One row per file: rows, time span and missing values; the base of the roll-ups."""
    return readings.groupBy(*FILE_KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("min_time"),
        F.max("timestamp").alias("max_time"),
        *[_missing(m).alias(f"missing_{m}") for m in CHECKED],
    )


def missing_profile(readings: DataFrame) -> DataFrame:
    """Missing values per file and column (measures and treatment), count and percent."""
    return file_table(readings).select(
        "period",
        "file",
        "rows",
        *[F.col(f"missing_{m}") for m in CHECKED],
        *[
            (F.col(f"missing_{m}") * 100.0 / F.col("rows")).alias(f"missing_{m}_pct")
            for m in CHECKED
        ],
    )


def missing_by_column(readings: DataFrame) -> DataFrame:
    """Per file and column the missing values, the file's total and how to report it."""
    total = sum((F.col(f"missing_{m}") for m in CHECKED), F.lit(0))
    named = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(f"missing_{m}").alias("n")) for m in CHECKED]
    )
    return (
        file_table(readings)
        .withColumn("total_missing", total.cast("bigint"))
        .select("period", "file", "total_missing", F.inline(named).alias("measure", "n_missing"))
        .withColumn(
            "verdict",
            F.when(F.col("total_missing") == 0, "none")
            .when(F.col("total_missing") < MAX_LISTED_INVALID, "listed")
            .otherwise("too many"),
        )
    )


def rows_with_missing(readings: DataFrame, order: str = "file_order") -> DataFrame:
    """The rows behind files with fewer than ten missing values.

    Each file's rows are numbered only up to the limit (a group limit before the shuffle).
    """
    gaps = sum((F.col(m).isNull().cast("int") for m in CHECKED), F.lit(0))
    by_file = Window.partitionBy("period", "file")
    bounded = (
        readings.select("period", "file", order, gaps.alias("n_missing"))
        .where(F.col("n_missing") > 0)
        .withColumn("_n", F.row_number().over(by_file.orderBy(order)))
        .where(F.col("_n") <= MAX_LISTED_INVALID)
    )
    return (
        bounded.withColumn("_total", F.sum("n_missing").over(by_file))
        .where(F.col("_total") < MAX_LISTED_INVALID)
        .drop("_n", "_total")
    )


def type_distribution(readings: DataFrame) -> DataFrame:
    """Rows and percent of each treatment per file."""
    counted = readings.groupBy("period", "file", "wall_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("period", "file"))
    return counted.withColumn("pct", F.col("n") * 100.0 / total)


def sensor_mapping(readings: DataFrame, order: str = "file_order") -> DataFrame:
    """What each file holds - sensor, wall, rows, treatments in order of appearance.

    The treatment text is cut as the report cuts it, so only as many distinct values as can show in
    it are joined; their number is exact.
    """
    per_type = readings.groupBy(*FILE_KEYS, "wall_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    by_file = Window.partitionBy(*FILE_KEYS)
    known = F.col("wall_type").isNotNull()
    ranked = per_type.withColumn(
        "rank",
        F.row_number().over(by_file.orderBy(known.desc(), F.col("first"), F.col("wall_type"))),
    )
    shown = F.when(known & (F.col("rank") <= TYPE_LIST_WIDTH), F.struct("rank", "wall_type"))
    listed = F.transform(F.array_sort(F.collect_list(shown)), lambda e: e["wall_type"])
    text = F.array_join(listed, ", ")
    grouped = ranked.groupBy(*FILE_KEYS).agg(
        F.sum("n").alias("rows"),
        F.count_if(known).alias("n_wall_types"),
        F.when(F.count_if(known) == 0, "N/A")
        .when(F.length(text) > TYPE_LIST_WIDTH, F.concat(F.left(text, F.lit(TYPE_LIST_CUT)), F.lit("...")))
        .otherwise(text)
        .alias("wall_types"),
    )
    return with_topology(grouped)


def sensor_availability(
    readings: DataFrame, group: Sequence[str] = ("period", "box_id")
) -> DataFrame:
    """Sensors found (any id) and expected ones missing per group, as counts and sorted lists.

    A group whose ids are all NULL has none. Per period and box, every expected box has a line, also without rows.
    """
    sensors = readings.groupBy(*group, "sensor_id").agg(F.bit_or(_bit(F.col("sensor_id"))).alias("bit"))
    per_group = sensors.groupBy(*group).agg(
        F.array_sort(F.collect_list("sensor_id")).alias("ids"), F.bit_or("bit").alias("mask")
    )
    if list(group) == ["period", "box_id"]:
        per_group = per_group.join(_expected_boxes(readings), list(group), "full")
        per_group = per_group.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    absent = _sensors_in(F.col("mask"), present=False)
    return per_group.select(
        *group,
        F.size("ids").cast("bigint").alias("n_found"),
        F.size(absent).cast("bigint").alias("n_missing"),
        F.concat_ws(",", F.col("ids").cast("array<string>")).alias("found"),
        F.concat_ws(",", absent.cast("array<string>")).alias("missing"),
    )


def missing_sensors(readings: DataFrame, group: Sequence[str] = ("period", "box_id")) -> DataFrame:
    """Expected sensors (1..16) without any row, one row per (group, sensor).

    The difference is taken inside each group's bit mask, one aggregate. Per period and box, every expected box
    counts: one without any row misses all its sensors.
    """
    masks = readings.groupBy(*group).agg(F.bit_or(_bit(F.col("sensor_id"))).alias("mask"))
    if list(group) == ["period", "box_id"]:
        masks = masks.join(_expected_boxes(readings), list(group), "full")
    return masks.select(
        *group, F.explode(_sensors_in(F.col("mask"), present=False)).alias("sensor_id")
    )


def missing_sensors_on_grid(
    levels: DataFrame, width: str, periods: Sequence[tuple] = tuple(PERIODS)
) -> DataFrame:
    """Expected sensors without a row, per period, box and bin of ``width``, bins without any row included.

    ``levels`` has binned rows. The grid of all bins of the periods is generated by Spark and meets one bit mask per bin;
    a sensor with an id outside the expected ones is of no account, nor are rows outside the periods.
    """
    masks = levels.groupBy(*BOX_KEYS).agg(F.bit_or(_bit(F.col("sensor_id"))).alias("mask"))
    step = F.expr(f"interval '{width.split()[0]}' {width.split()[1]}")
    ends = periods_table(levels.sparkSession, periods)
    ends = ends.withColumn("first", bin_start("start", width)).withColumn("last", bin_start("end", width))
    days = ends.select("period", F.explode(F.sequence("first", "last", step)).alias("timestamp"))
    grid = days.withColumn("box_id", F.explode(F.array(*[F.lit(box) for box in BOX_NAMES])))
    return grid.join(masks, BOX_KEYS, "left").select(
        *BOX_KEYS, F.explode(_sensors_in(F.col("mask"), present=False)).alias("sensor_id")
    )


def coverage(readings: DataFrame) -> DataFrame:
    """Sensors present per (period, box, wall), split by position, of four expected."""
    sensors = with_topology(readings.select("period", "box_id", "sensor_id").distinct())
    masks = (
        sensors.where(F.col("wall_id").isNotNull())
        .groupBy("period", "box_id", "wall_id")
        .agg(
            F.bit_or(F.when(F.col("position") == "out", _bit(F.col("sensor_id")))).alias("out"),
            F.bit_or(F.when(F.col("position") == "in", _bit(F.col("sensor_id")))).alias("in"),
        )
    )

    def listed(side: str) -> Column:
        return F.concat_ws(",", _sensors_in(F.col(side)).cast("array<string>"))

    def counted(side: str) -> Column:
        return F.size(_sensors_in(F.col(side))).cast("bigint")

    return masks.select(
        "period",
        "box_id",
        "wall_id",
        (counted("out") + counted("in")).alias("n_sensors"),
        F.lit(SENSORS_PER_WALL).cast("bigint").alias("n_expected"),
        listed("out").alias("out_sensors"),
        listed("in").alias("in_sensors"),
    )


def period_summary(readings: DataFrame) -> DataFrame:
    """Per period rows, distinct sensors and boxes, time span and whole days."""
    return (
        file_table(readings)
        .groupBy("period")
        .agg(
            F.sum("rows").alias("rows"),
            F.count_distinct("sensor_id").alias("n_sensors"),
            F.count_distinct("box_id").alias("n_boxes"),
            F.min("min_time").alias("min_time"),
            F.max("max_time").alias("max_time"),
        )
        .withColumn("duration_days", whole_days(F.col("min_time"), F.col("max_time")))
    )


def sensor_summary(readings: DataFrame) -> DataFrame:
    """Per sensor its wall, rows and missing values."""
    table = file_table(readings).groupBy("period", "box_id", "sensor_id").agg(
        F.sum("rows").alias("rows"),
        *[F.sum(f"missing_{m}").alias(f"missing_{m}") for m in CHECKED],
    )
    return with_topology(table)


def file_profile(readings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Status, rows, time span and NULLs of each file.

    ``files`` (period, file, reason, rows), the status table of an ingest, adds the files that could not be read:
    FAILED without a header or columns to read, ERROR for the rest.
    """
    nulls = sum((F.col(f"missing_{m}") for m in CHECKED), F.col("missing_timestamp"))
    profile = (
        readings.groupBy("period", "file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("min_time"),
            F.max("timestamp").alias("max_time"),
            *[_missing(m).alias(f"missing_{m}") for m in [*CHECKED, "timestamp"]],
        )
        .select(
            "period",
            "file",
            F.lit("SUCCESS").alias("status"),
            "rows",
            "min_time",
            "max_time",
            (nulls > 0).alias("has_nulls"),
            nulls.alias("null_count"),
        )
    )
    if files is None:
        return profile
    failed = files.where(F.col("reason").isNotNull()).select(
        "period",
        "file",
        F.when(F.col("reason").isin(*FAILED_REASONS), "FAILED").otherwise("ERROR").alias("status"),
        F.lit(0).cast("bigint").alias("rows"),
    )
    return profile.unionByName(failed, allowMissingColumns=True)


def _bounded_list(
    rows: DataFrame, keys: Sequence[str], timestamp: str, below: int, name: str
) -> DataFrame:
    """Sorted times of each group as text, only for groups with fewer than ``below`` rows.

    At most ``below`` rows of a group leave a task, however large the group is.
    """
    ranked = rows.select(*keys, timestamp).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(timestamp))
    )
    text = F.transform(F.array_sort(F.collect_list(timestamp)), to_seconds_text)
    return (
        ranked.where(F.col("_n") <= below)
        .groupBy(*keys)
        .agg(
            F.when(F.count(F.lit(1)) < below, F.array_join(text, ", ")).alias(name)
        )
    )


def range_check(readings: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Rows of each file inside and outside its period; few invalid times are listed.

    Rows without a time count in the total only.
    """
    flagged = with_range_flag(readings.select("period", "file", "timestamp"), periods)
    counts = flagged.groupBy("period", "file").agg(
        F.count_if(F.col("in_range")).alias("valid_rows"),
        F.count_if(~F.col("in_range")).alias("invalid_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    invalid = _bounded_list(
        flagged.where(~F.col("in_range")),
        ["period", "file"],
        "timestamp",
        MAX_LISTED_INVALID,
        "invalid_times",
    )
    return counts.withColumn(
        "percent_valid", F.col("valid_rows") * 100.0 / F.col("total_rows")
    ).join(invalid, ["period", "file"], "left")


def valid_rollup(readings: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Files and valid rows per box and, below it, per wall (``wall_id`` NULL = whole box).

    Expected boxes and walls without files are there with zeros.
    """
    flagged = with_range_flag(readings.select(*FILE_KEYS, "timestamp"), periods)
    files = with_topology(
        flagged.groupBy(*FILE_KEYS).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("in_range")).alias("valid_rows")
        )
    ).where(F.col("box_id").isNotNull())
    grouped = files.groupingSets(
        [["period", "box_id", "wall_id"], ["period", "box_id"]], "period", "box_id", "wall_id"
    ).agg(
        F.grouping("wall_id").alias("whole"),
        F.count_distinct("file").alias("n_files"),
        F.sum("rows").alias("rows"),
        F.sum("valid_rows").alias("valid_rows"),
    )
    found = grouped.where((F.col("whole") == 1) | F.col("wall_id").isNotNull()).drop("whole")
    expected = _expected_boxes(readings, walls=True)
    same = [
        found[c].eqNullSafe(expected[c]) if c == "wall_id" else found[c] == expected[c]
        for c in ("period", "box_id", "wall_id")
    ]
    every = found.join(expected, same, "full").select(
        *[F.coalesce(found[c], expected[c]).alias(c) for c in ("period", "box_id", "wall_id")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "rows", "valid_rows")],
    )
    return every.select(
        "period",
        "box_id",
        box_name(F.col("box_id")).alias("box_name"),
        "wall_id",
        "n_files",
        F.when(F.col("wall_id").isNull(), SENSORS_PER_BOX)
        .otherwise(SENSORS_PER_WALL)
        .cast("bigint")
        .alias("n_expected"),
        "rows",
        "valid_rows",
    )


def rows_per_day(readings: DataFrame, expected: int = READINGS_PER_DAY) -> DataFrame:
    """Rows of each file per day against the expected number, and the file's daily average."""
    daily = (
        readings.where(F.col("timestamp").isNotNull())
        .groupBy("period", "file", F.col("timestamp").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return daily.withColumns(
        {
            "as_expected": F.col("rows") == expected,
            "avg_per_day": F.avg("rows").over(Window.partitionBy("period", "file")),
        }
    )


def audit_report(readings: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Totals per period, per box and per wall in one table (``level`` names the roll-up).

    ``status`` has every file found (period, file, box_id, sensor_id, reason). With it, files that couldn't be read
    count in ``n_files`` too, without rows, and ``n_failed`` tells how many they are; a file without a box or sensor in
    its name is in the totals of its period alone. ``failed_files`` lists them.
    """
    table = file_table(readings).withColumn("failed", F.lit(False))
    if status is not None:
        lost = failed_files(status).drop("reason").withColumn("failed", F.lit(True)).withColumn("rows", F.lit(0).cast("long"))
        table = table.unionByName(lost, allowMissingColumns=True)
    files = with_topology(table)
    grouped = files.groupingSets(
        [["period"], ["period", "box_id"], ["period", "box_id", "wall_id"]],
        "period",
        "box_id",
        "wall_id",
    ).agg(
        (F.grouping("box_id") + F.grouping("wall_id")).alias("folded"),
        F.count_distinct("file").alias("n_files"),
        F.count_if("failed").alias("n_failed"),
        F.sum("rows").alias("rows"),
        F.min("min_time").alias("min_time"),
        F.max("max_time").alias("max_time"),
        *[F.sum(f"missing_{m}").alias(f"missing_{m}") for m in CHECKED],
        F.bit_or(F.when(~F.col("failed"), _bit(F.col("sensor_id")))).alias("mask"),
    )
    level = (
        F.when(F.col("folded") == 2, "period").when(F.col("folded") == 1, "box").otherwise("wall")
    )
    absent = _sensors_in(F.col("mask"), present=False).cast("array<string>")
    return (
        grouped.withColumn("level", level)
        .where((F.col("level") != "wall") | F.col("wall_id").isNotNull())
        .where((F.col("level") == "period") | F.col("box_id").isNotNull() | (F.col("n_files") > F.col("n_failed")))
        .select(
            "level",
            "period",
            "box_id",
            "wall_id",
            "n_files",
            *([] if status is None else ["n_failed"]),
            "rows",
            "min_time",
            "max_time",
            *[f"missing_{m}" for m in CHECKED],
            F.when(F.col("level") == "box", F.concat_ws(",", absent)).alias("missing_sensors"),
        )
    )


def failed_files(status: DataFrame) -> DataFrame:
    """The files that couldn't be read, and why."""
    return status.where(F.col("reason").isNotNull()).select("period", "file", "box_id", "sensor_id", "reason")


def readiness(readings: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """One row - does every expected period have data?"""
    names = [name for name, *_ in periods]
    return readings.agg(
        *[
            F.coalesce(F.bool_or(F.col("period") == name), F.lit(False)).alias(f"has_{name.lower()}")
            for name in names
        ]
    ).withColumn("ready", F.expr(" and ".join(f"has_{name.lower()}" for name in names)))


def range_audit(readings: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Per file its original span, rows and missing values in range, and two warnings."""
    ranges = {name: start for name, start, _ in periods}
    first_day = F.lit(None).cast("date")
    for name, start in ranges.items():
        first_day = F.when(F.col("period") == name, F.lit(start.date())).otherwise(first_day)
    flagged = with_range_flag(
        readings.where(F.col("timestamp").isNotNull()).select(*FILE_KEYS, "timestamp", *CHECKED),
        periods,
    )
    inside = F.coalesce(F.col("in_range"), F.lit(False))
    table = flagged.groupBy(*FILE_KEYS).agg(
        F.min("timestamp").alias("orig_start"),
        F.max("timestamp").alias("orig_end"),
        F.count(F.lit(1)).alias("orig_rows"),
        F.count_if(inside).alias("range_rows"),
        *[F.count_if(inside & F.col(m).isNull()).alias(f"missing_{m}") for m in CHECKED],
    )
    return table.withColumns(
        {
            "other_start_day": F.col("orig_start").cast("date") != first_day,
            "very_few_rows": F.col("range_rows") < LOW_ROW_COUNT,
        }
    )


def missing_times(readings: DataFrame, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Times of missing values in range per file and measure, where fewer than seven."""
    flagged = with_range_flag(
        readings.where(F.col("timestamp").isNotNull()).select(
            "period", "file", "timestamp", *CHECKED
        ),
        periods,
    ).where("in_range")
    absent = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in CHECKED]))
    cells = flagged.select("period", "file", "timestamp", F.explode(absent).alias("measure"))
    return _bounded_list(
        cells, ["period", "file", "measure"], "timestamp", MAX_LISTED_MISSING, "missing_at"
    ).where(F.col("missing_at").isNotNull())


def first_readings(readings: DataFrame, order: str = "file_order") -> DataFrame:
    """The first row of each file, as the load report shows it.

    The first order key per file is a hash aggregate, staged as one row per file so that Catalyst
    knows its size; its row is then picked by an equi-join.
    """
    heads = stage(readings.groupBy("period", "file").agg(F.min(order).alias(order)), "heads")
    return readings.select("period", "file", order, "timestamp", *MEASURES, "wall_type").join(
        heads, ["period", "file", order], "left_semi"
    )


def overview(sensor: DataFrame) -> DataFrame:
    """Rows per level, and the distinct periods, sensors and walls in them.

    All from one pass over the sensor level: a wall or box has a row for each bin in which one of its sensors has one.
    Bins are counted where the sensor level has them together, so only a row per sensor and its bins' heads move on.
    """
    bins = sensor.groupBy("period", "box_id", "timestamp").agg(
        F.collect_set(F.struct("wall_id", "sensor_id")).alias("sensors")
    )
    walls = F.array_distinct(F.transform("sensors", lambda s: s["wall_id"]))
    walls = F.filter(walls, lambda w: w.isNotNull())
    items = F.concat(
        F.transform("sensors", lambda s: _item("sensor", s["sensor_id"])),
        F.transform(walls, lambda w: _item("wall", w)),
        F.array(_item("box", F.lit(None).cast("int"))),
    )
    counted = (
        bins.select("period", "box_id", F.inline(items))
        .groupBy("level", "period", "box_id", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("level").agg(
        F.sum("n").alias("rows"),
        F.count_distinct("period").alias("n_periods"),
        F.count_distinct("box_id", F.coalesce("item", F.lit(-1))).alias("n_items"),
    )


def _item(level: str, item: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), item.cast("int").alias("item"))
