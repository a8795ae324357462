"""Delay between two paired series by cross-correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.functions.timebins import MICROS_PER_DAY, floor_to, micros
from thermaline.operators.chunks import row_positions
from thermaline.staging import stage

# Guard added to denominators, fewest pairs for a result, longest delay and bin length.
EPSILON = 1e-8
MIN_PAIRS = 10
MAX_LAG_HOURS = 12
BIN_MINUTES = 10

_BLOCK = 4096
_CHUNK = 32 * MICROS_PER_DAY


def thermal_lag(
    df: DataFrame,
    keys: Sequence[str],
    outside: str = "out_surface",
    inside: str = "in_surface",
    timestamp: str = "timestamp",
    max_lag_hours: int = MAX_LAG_HOURS,
    bin_minutes: int = BIN_MINUTES,
) -> DataFrame:
    """Delay of ``inside`` behind ``outside`` per series, and the correlation at that delay.

    Pairs with a missing side are removed and the rest closes up. The score of a shift is the plain sum
    of z-score products (not divided by the overlap); the first maximum wins. ``r`` is Pearson's on
    the overlap. Series with fewer than ``MIN_PAIRS`` pairs get NULLs.

    Rows are grouped into blocks of consecutive positions that also hold the first ``max_lag`` rows of
    the next block, so each block scores all shifts alone, and only (block, shift) sums are shuffled.
    """
    max_lag = max_lag_hours * 60 // bin_minutes
    block = max(_BLOCK, max_lag)
    series = stage(
        df.select(*keys, timestamp, F.col(outside).alias("o"), F.col(inside).alias("i")),
        "lag-series",
    )
    pairs = series.where(F.col("o").isNotNull() & F.col("i").isNotNull())
    stats = stage(
        pairs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("o").alias("mean_o"),
            F.avg("i").alias("mean_i"),
            (F.stddev_pop("o") + EPSILON).alias("spread_o"),
            (F.stddev_pop("i") + EPSILON).alias("spread_i"),
        )
        .where(F.col("n") >= MIN_PAIRS),
        "lag-stats",
    )
    placed = stage(
        row_positions(pairs, keys, [timestamp], floor_to(micros(F.col(timestamp)), _CHUNK), "pos")
        .join(stats, list(keys))
        .select(
            *keys,
            "pos",
            "n",
            "o",
            "i",
            ((F.col("o") - F.col("mean_o")) / F.col("spread_o")).alias("zo"),
            ((F.col("i") - F.col("mean_i")) / F.col("spread_i")).alias("zi"),
        ),
        "lag-positions",
    )
    scores = _block_scores(placed, keys, max_lag, block)
    best = stage(
        scores.groupBy(*keys)
        .agg(F.min(F.struct((-F.col("score")).alias("worse"), "shift"))["shift"].alias("shift"))
        .select(*keys, "shift"),
        "lag-best",
    )
    correlated = _correlation_at(placed.join(best, list(keys)), placed, keys)
    return series.select(*keys).distinct().join(
        correlated.select(
            *keys, (F.col("shift") * bin_minutes).cast("int").alias("lag_minutes"), "r"
        ),
        list(keys),
        "left",
    )


def _block_scores(placed: DataFrame, keys: Sequence[str], max_lag: int, block: int) -> DataFrame:
    """Sum of products per (series, shift), from blocks with a tail of ``max_lag`` inside values."""
    home = floor_to(F.col("pos"), block)
    tail = (F.col("pos") - home < max_lag) & (home > 0)
    spread = placed.withColumn(
        "block", F.explode(F.when(tail, F.array(home, home - block)).otherwise(F.array(home)))
    )
    blocks = spread.groupBy(*keys, "n", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "zo", "zi"))).alias("rows")
    )
    outside = F.transform(
        F.filter("rows", lambda row: row["pos"] < F.col("block") + block), lambda row: row["zo"]
    )
    inside = F.transform("rows", lambda row: row["zi"])

    def score(shift: Column) -> Column:
        shifted = F.slice(F.col("inside"), shift + 1, F.size("outside"))
        products = F.zip_with(F.col("outside"), shifted, lambda zo, zi: zo * zi)
        return F.aggregate(
            products, F.lit(0.0), lambda total, product: total + F.coalesce(product, F.lit(0.0))
        )

    shifts = F.sequence(F.lit(0), F.least(F.lit(max_lag), F.col("n") - 1).cast("int"))
    return (
        blocks.select(*keys, "n", outside.alias("outside"), inside.alias("inside"))
        .select(*keys, F.posexplode(F.transform(shifts, score)).alias("shift", "part"))
        .groupBy(*keys, "shift")
        .agg(F.sum("part").alias("score"))
    )


def _correlation_at(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson's r of the pairs (o at p, i at p + shift); a single pair gives score / n."""
    aligned = left.select(
        *keys, "shift", "n", "o", "zo", (F.col("pos") + F.col("shift")).alias("pos")
    ).join(right.select(*keys, "pos", "i", "zi"), [*keys, "pos"])
    moments = aligned.groupBy(*keys, "shift", "n").agg(
        F.count(F.lit(1)).alias("m"),
        F.covar_pop("o", "i").alias("covariance"),
        F.var_pop("o").alias("var_o"),
        F.var_pop("i").alias("var_i"),
        F.sum(F.col("zo") * F.col("zi")).alias("score"),
    )
    pearson = (
        F.col("covariance")
        * F.col("m")
        / (F.sqrt(F.col("var_o") * F.col("m") * F.col("var_i") * F.col("m")) + EPSILON)
    )
    return moments.withColumn(
        "r", F.when(F.col("m") > 1, pearson).otherwise(F.col("score") / F.col("n"))
    )
