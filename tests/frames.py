"""Small literal frames."""

from __future__ import annotations

from datetime import datetime, timedelta

START = datetime(2025, 10, 23, 0, 0)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


READING = (
    "period string, file string, file_order bigint, box_id int, sensor_id int, "
    "timestamp timestamp_ntz, surface_temp double, internal_temp double, room_temp double, "
    "wall_type string"
)


def readings(spark, rows):
    """Rows of (box, sensor, minutes, surface, internal, room, type)."""
    full = [
        ("Period1", f"GW_{box}.{sensor}_111025.csv", i, box, sensor, at(m), s, t, r, kind)
        for i, (box, sensor, m, s, t, r, kind) in enumerate(rows)
    ]
    return spark.createDataFrame(full, READING)


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    picked = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(picked, key=lambda t: tuple((v is None, str(type(v)), v) for v in t))
