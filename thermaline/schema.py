"""Column sets, fixed experiment values and the small dimensions built from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Sensor topology of one box (wall -> outside sensors, inside sensors).
WALL_SENSORS = {
    1: ([1, 2], [9, 10]),
    2: ([3, 4], [11, 12]),
    3: ([5, 6], [13, 14]),
    4: ([7, 8], [15, 16]),
}

# Experiment periods, both ends inclusive.
PERIODS = [
    ("Period1", datetime(2025, 10, 23, 0, 0, 0), datetime(2025, 11, 6, 23, 59, 59)),
    ("Period2", datetime(2025, 12, 3, 11, 0, 0), datetime(2025, 12, 11, 11, 59, 59)),
]

# Counts the experiment is expected to show.
SENSORS_PER_BOX = 16
READINGS_PER_BIN = 32
READINGS_PER_DAY = 144
SENSORS_PER_WALL = 4

# Spelling corrections for treatment names.
WALL_TYPE_CORRECTIONS = {"Yraka": "Yarka"}

# Box names.
BOX_NAMES = {1: "Control", 2: "Experimental"}

# Smoothing windows offered.
SMOOTHING_WINDOWS = ["1h", "3h", "12h"]

MEASURES = ["surface_temp", "internal_temp", "room_temp"]
SERIES_KEYS = ["period", "box_id", "sensor_id"]
WALL_KEYS = ["period", "box_id", "wall_id", "timestamp"]
BOX_KEYS = ["period", "box_id", "timestamp"]

BOX_SMOOTHED = ["internal_temp", "surface_temp", "normalized_internal", "normalized_surface"]
WALL_SMOOTHED = [
    "out_internal",
    "in_internal",
    "out_surface",
    "in_surface",
    "surface_gradient",
    "internal_gradient",
]

READINGS_SCHEMA = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("box_id", T.IntegerType()),
        T.StructField("sensor_id", T.IntegerType()),
        T.StructField("wall_id", T.IntegerType()),
        T.StructField("position", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("surface_temp", T.DoubleType()),
        T.StructField("internal_temp", T.DoubleType()),
        T.StructField("room_temp", T.DoubleType()),
        T.StructField("wall_type", T.StringType()),
    ]
)

TOPOLOGY_SCHEMA = "sensor_id int, wall_id int, position string"
PERIODS_SCHEMA = "period string, start timestamp_ntz, end timestamp_ntz"


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from driver-side rows with a known size.

    It goes in through Arrow as a local relation, so Catalyst sees its true size: it broadcasts the
    table on its own while it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    """
    names = [field.split()[0] for field in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns)))), schema)


def topology(spark: SparkSession) -> DataFrame:
    """J1 dimension: one row per sensor of a box (16 rows)."""
    rows = [
        (sensor, wall, position)
        for wall, (outside, inside) in WALL_SENSORS.items()
        for position, sensors in (("out", outside), ("in", inside))
        for sensor in sensors
    ]
    return small_table(spark, rows, TOPOLOGY_SCHEMA)


def periods_table(spark: SparkSession, periods: Sequence[tuple] = tuple(PERIODS)) -> DataFrame:
    """Period dimension ``(period, start, end)``, both ends inclusive."""
    return small_table(spark, periods, PERIODS_SCHEMA)
