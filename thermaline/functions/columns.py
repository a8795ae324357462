"""Column expressions: derived temperatures, labels, buckets and measure choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.schema import BOX_NAMES, WALL_TYPE_CORRECTIONS


def bin_start(timestamp: str, width: str) -> Column:
    """P10: start of the calendar bin of ``width`` that holds ``timestamp``."""
    return F.window(F.col(timestamp), width)["start"]


def clean_wall_type(value: Column) -> Column:
    """Trimmed treatment name with known misspellings corrected."""
    trimmed = F.trim(value)
    fixed = trimmed
    for wrong, right in WALL_TYPE_CORRECTIONS.items():
        fixed = F.when(trimmed == wrong, F.lit(right)).otherwise(fixed)
    return fixed


# Fixed value: the texts that are numbers - decimal notation and infinity; no unit, type letter or hexadecimal digits.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def to_number(value: Column) -> Column:
    """Text to double; anything unreadable, and NaN itself, becomes NULL."""
    return F.when(F.rlike(value, F.lit(NUMBER_PATTERN)), F.trim(value).try_cast("double"))


def normalized_columns() -> dict[str, Column]:
    """P5: temperatures relative to the room."""
    return {
        "normalized_surface": F.col("surface_temp") - F.col("room_temp"),
        "normalized_internal": F.col("internal_temp") - F.col("room_temp"),
    }


def with_gradients(wall: DataFrame) -> DataFrame:
    """P6 + P7: the gradient chain from room air to the inside of the wall."""
    return wall.withColumn(
        "internal_avg", (F.col("out_internal") + F.col("in_internal")) / 2
    ).withColumns(
        {
            "gradient_air_to_out_surface": F.col("out_surface") - F.col("room_temp"),
            "gradient_out_to_in_surface": F.col("in_surface") - F.col("out_surface"),
            "gradient_in_surface_to_internal": F.col("internal_avg") - F.col("in_surface"),
            "total_gradient": F.col("internal_avg") - F.col("room_temp"),
            "surface_gradient": F.col("out_surface") - F.col("in_surface"),
            "internal_gradient": F.col("out_internal") - F.col("in_internal"),
        }
    )


def round_half_even(value: Column, places: int) -> Column:
    """Decimal rounding with ties to even, as ``rint`` on the scaled value (0.25 -> 0.2)."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def box_name(box_id: Column) -> Column:
    """Control / Experimental."""
    label = F.lit(None).cast("string")
    for box, name in BOX_NAMES.items():
        label = F.when(box_id == box, F.lit(name)).otherwise(label)
    return label


def measure(df: DataFrame, base: str, normalized: bool = False, smoothed: bool = False) -> Column:
    """The column to show for a measure - raw or room-relative, smoothed where available.

    ``base`` is a box measure (``internal_temp``, ``surface_temp``) or a wall measure
    (``in_internal``, ``in_surface``, ``out_surface``).
    """
    name = base
    if normalized:
        if base.endswith("_temp"):
            name = "normalized_" + base.removesuffix("_temp")
        else:
            position, quantity = base.split("_", 1)
            name = f"{position}_normalized_{quantity}"
    if smoothed and f"{name}_smooth" in df.columns:
        name = f"{name}_smooth"
    return F.col(name)

