"""Gapless numbers within a key, for keys that may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int
) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each key, without nulls in the keys.

    A key's rows are dealt to hash blocks of about ``BLOCK_ROWS`` by ``order``; each block is numbered by itself
    and starts where the blocks before it end. ``rows`` is the number of rows of ``df``, which is read twice and so
    should be a written table. Rows that agree in ``order`` are numbered one after the other in any order.
    """
    blocks = rows // BLOCK_ROWS + 1
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, [*keys, "_block"])
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_at", "_start", "_block")
    )
