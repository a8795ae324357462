"""Readings from a generic ``events`` table, seen as the sensors of two boxes.

Event ids are dealt to 2 boxes x 16 sensors; a "file" is one sensor in one period, and the event id
is the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.functions.timebins import format_logger_time

# The split of the month into two periods, and the file date code of each.
PERIOD_SPLIT = "2024-01-16 00:00:00"
PERIOD_CODES = {"Period1": "111025", "Period2": "121125"}


EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without topology, plus ``file_order`` and ``label`` (a second category)."""
    ts = F.col("ts")
    # props is one flat object with the number k, so a pattern reads it several times faster than JSON
    number = F.regexp_extract("props", r'"k":\s*(-?[0-9.]+)', 1)
    first_period = ts < F.lit(PERIOD_SPLIT).cast("timestamp_ntz")
    base = read_events(spark, sf_dir).select(
        F.when(first_period, F.lit("Period1")).otherwise(F.lit("Period2")).alias("period"),
        (F.col("event_id") % 2 + 1).cast("int").alias("box_id"),
        (F.shiftright("event_id", 1) % 16 + 1).cast("int").alias("sensor_id"),
        ts.alias("timestamp"),
        F.when(F.col("event_id") % 89 != 0, number.try_cast("double")).alias("surface_temp"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("internal_temp"),
        (F.lit(20.0) + F.hour(ts) / F.lit(2.0)).alias("room_temp"),
        F.col("event_type").alias("label"),
        F.col("event_id").alias("file_order"),
    )
    code = F.when(F.col("period") == "Period1", F.lit(PERIOD_CODES["Period1"])).otherwise(
        F.lit(PERIOD_CODES["Period2"])
    )
    day = F.dayofmonth("timestamp")
    return base.withColumns(
        {
            "file": F.concat(
                F.lit("GW_"), F.col("box_id"), F.lit("."), F.col("sensor_id"), F.lit("_"), code,
                F.lit(".csv"),
            ),
            "wall_type": F.when((F.col("box_id") == 1) | (day <= 8), "Exposed")
            .when(day <= 16, "Yarka")
            .when(day <= 24, "Dry soil")
            .otherwise("Succalents"),
        }
    ).withColumn("wall_type", F.when(F.col("file_order") % 83 != 5, F.col("wall_type")))


def logger_slices(readings: DataFrame) -> DataFrame:
    """Readings as the logger files of a messy drop: ``source_period`` (folder), ``file``.

    Each sensor writes one file per five days. Files of the first 15 days lie in the first folder,
    later ones in the second, but sensors 7 and 14 of the first box were dropped in the wrong folder.
    """
    slot = F.least(F.lit(5), F.floor((F.dayofmonth("timestamp") - 1) / 5).cast("int"))
    early = slot < 3
    swapped = (F.col("box_id") == 1) & F.col("sensor_id").isin(7, 14)
    folder = F.when(early != swapped, F.lit("Period1")).otherwise(F.lit("Period2"))
    name = F.concat(
        F.lit("GW_"), F.col("box_id"), F.lit("."), F.col("sensor_id"), F.lit("_"), slot,
        F.lit(".csv"),
    )
    return readings.withColumns({"source_period": folder, "file": name})


def dirty_logger_rows(readings: DataFrame) -> DataFrame:
    """The readings as text a logger might have written, blemishes included.

    Files rotate by ranges of the event id, so none grows with the table. Blemishes are a function of
    the event id: unreadable times, text in a number column, numbers with a unit, a type letter or in hexadecimal
    digits, a misspelled and padded treatment, and Latin-1 bytes in the headers of the second box. One sensor's file names do not parse.
    """
    order = F.col("file_order")
    part = F.lpad(F.shiftright("file_order", 26).cast("string"), 8, "0")
    unnamed = (F.col("box_id") == 2) & (F.col("sensor_id") == 16)
    name = F.concat(
        F.when(unnamed, F.lit("GX-")).otherwise(F.lit("GW_")),
        F.col("box_id"), F.lit("."), F.col("sensor_id"), F.lit("_"), part, F.lit(".csv"),
    )
    degree = F.when(F.col("box_id") == 2, F.expr("cast(X'B0' as string)")).otherwise("°")
    header = F.concat(
        F.lit("Date/Time,Value Heat Surface Sensor,Internal temp sensor ("), degree,
        F.lit("C),Out Air temp,Wall Type"),
    )
    return readings.select(
        F.col("period").alias("folder"),
        name.alias("file"),
        order.alias("file_order"),
        F.when(order % 101 == 50, F.lit("no time"))
        .otherwise(format_logger_time(F.col("timestamp")))
        .alias("date_text"),
        F.col("surface_temp").cast("string").alias("surface_temp"),
        F.coalesce(F.col("internal_temp").cast("string"), F.lit("NaN")).alias("internal_temp"),
        F.when(order % 211 == 7, F.lit("err"))
        .when(order % 211 == 8, F.lit("72.5F"))
        .when(order % 211 == 9, F.lit("1d"))
        .when(order % 211 == 10, F.lit("0x1p3"))
        .otherwise(F.col("room_temp").cast("string"))
        .alias("room_temp"),
        F.when(F.col("wall_type") == "Yarka", F.lit(" Yraka "))
        .otherwise(F.col("wall_type"))
        .alias("wall_type"),
        header.alias("header"),
    )
