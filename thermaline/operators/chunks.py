"""Ordered work on one long series, spread over many tasks.

A series is cut into chunks of its order key. Window functions run inside (series, chunk); what has
to cross a chunk border travels in a table with one row per chunk. No task ever holds a whole series,
so a series that carries a large share of all rows costs no more than the others. A NULL series key is a
series of its own: tables meet on a struct of the keys, whose NULL fields are equal to each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_of(keys: Sequence[str]) -> Column:
    """The keys of a series as one value that's never NULL, for equi-joins."""
    return F.struct(*keys)


def row_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "row_index"
) -> DataFrame:
    """0-based position of each row in its series, by ``order``.

    ``chunk`` must not decrease along ``order``. Chunk sizes give each chunk's offset; the offsets
    come back by an equi-join on (series, chunk), the partitioning the rows have already.
    ``df`` is read twice, once with the key columns only: stage an input that is costly to compute.
    """
    chunked = df.withColumn("_chunk", chunk).withColumn("_series", series_of(keys))
    sizes = chunked.groupBy("_series", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy("_series").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "_series", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_series", "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_local", F.row_number().over(inside))
        .join(offsets, ["_series", "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_local") - 1)
        .drop("_series", "_chunk", "_local", "_offset")
    )
