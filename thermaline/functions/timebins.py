"""Arithmetic on zone-free timestamps: microsecond positions, chunks and text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_DAY = 86_400_000_000

# The logger writes M/D/YYYY H:MM; the audits also take seconds, or no time at all.
LOGGER_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2})$"
AUDIT_TIME = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
AUDIT_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def _in_utc() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") == "UTC"


def micros(timestamp: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone is.

    In a UTC session, as the package sets it, the cast to an instant is exact; in any other zone the
    value is put together from calendar parts, since local times may be skipped or doubled there.
    """
    if _in_utc():
        return F.unix_micros(timestamp.cast("timestamp"))
    seconds = (
        F.datediff(timestamp.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + F.hour(timestamp) * 3600
        + F.minute(timestamp) * 60
    )
    within = F.date_part(F.lit("SECOND"), timestamp) * 1_000_000
    return seconds * 1_000_000 + within.cast("bigint")


def from_micros(value: Column) -> Column:
    """Inverse of :func:`micros`."""
    if _in_utc():
        return F.timestamp_micros(value).cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days = F.floor(value / F.lit(MICROS_PER_DAY)).cast("int")
    rest = (value - days.cast("bigint") * MICROS_PER_DAY).cast("decimal(20,0)")
    seconds = (rest / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return epoch + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above an integer ``value`` (also below zero)."""
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def _rearranged(text: Column, pattern: str, iso: str) -> Column:
    """Text of a known shape as an ISO time, read without any time zone; else NULL."""
    matching = F.when(F.rlike(text, F.lit(pattern)), F.regexp_replace(text, pattern, iso))
    return matching.try_cast("timestamp_ntz")


def parse_logger_time(text: Column) -> Column:
    """``M/D/YYYY H:MM``; anything else is NULL."""
    return _rearranged(text, LOGGER_TIME, "$3-$1-$2 $4:$5:00")


def parse_any_time(text: Column) -> Column:
    """The logger's format, the audit formats, or an ISO time."""
    return F.coalesce(
        parse_logger_time(text),
        _rearranged(text, AUDIT_TIME, "$3-$1-$2 $4:$5:$6"),
        _rearranged(text, AUDIT_DATE, "$3-$1-$2"),
        text.try_cast("timestamp_ntz"),
    )


def format_logger_time(timestamp: Column) -> Column:
    """K5: ``M/D/YYYY H:MM``."""
    return F.concat(
        F.month(timestamp), F.lit("/"), F.dayofmonth(timestamp), F.lit("/"), F.year(timestamp),
        F.lit(" "), F.hour(timestamp), F.lit(":"),
        F.lpad(F.minute(timestamp).cast("string"), 2, "0"),
    )


def whole_days(start: Column, end: Column) -> Column:
    """Full days between two times."""
    return F.floor((micros(end) - micros(start)) / MICROS_PER_DAY)


def to_seconds_text(timestamp: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``."""
    return F.left(timestamp.cast("string"), F.lit(19))


# Units of a duration, unit -> microseconds.
DURATION_UNITS = {
    "us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "min": 60_000_000, "t": 60_000_000,
    "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000,
}


def duration_micros(text: str) -> int:
    """Microseconds of a positive duration such as ``30min``, ``3h``, ``1.5 h`` or ``1h30min``."""
    parts = re.findall(r"(\d+(?:\.\d+)?|)\s*([a-z]+)\s*", text.strip().lower())
    if "".join(n + u for n, u in parts) != re.sub(r"\s", "", text.lower()) or not parts:
        raise ValueError(f"not a duration: {text!r}")
    unknown = [unit for _, unit in parts if unit not in DURATION_UNITS]
    micros_ = 0 if unknown else round(sum(float(n or 1) * DURATION_UNITS[u] for n, u in parts))
    if micros_ <= 0:
        raise ValueError(f"not a positive duration: {text!r}")
    return micros_
