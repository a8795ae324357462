"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares are raised to an exponent and normalised to weights. The exponent is bisected: 1 keeps the shares, 0
makes all sources equal. It is the largest that reaches the target entropy, but not so small that a source would be
repeated more often than the limit. A source's tokens are put in blocks; each epoch is a permutation of its blocks,
and the last epoch ends where the source's budget of tokens does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.staging import stage

TARGET_ENTROPY = 0.95
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 1 << 17
POINTS = 63
PASSES = 6
#: A source's blocks are ordered in so many (2 to the power) ranges of their turns.
RANGE_BITS = 12

WORD = r"[^\x20\x09-\x0D]+"


def _scored(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of powers, sum of power times log share) of each exponent, in one aggregate."""
    row = shares.agg(
        *[
            F.struct(
                F.sum(F.exp(F.col("log_share") * a)).alias("z"),
                F.sum(F.exp(F.col("log_share") * a) * F.col("log_share")).alias("zl"),
            ).alias(f"e{i}")
            for i, a in enumerate(exponents)
        ]
    ).first()
    return [(r.z, r.zl) for r in row]


def bisected_exponent(
    shares: DataFrame, target_entropy: float, max_epochs: float
) -> float:
    """The exponent for sources with ``log_share``; every source is seen once at least.

    The entropy falls as the exponent rises. Each pass over the sources tries 63 exponents at once, which is six
    halvings of the interval; the sources never leave Spark.
    """
    count, low, high = shares.agg(F.count("*"), F.min("log_share"), F.max("log_share")).first()
    if not count or count == 1 or low == high:
        return 1.0
    # With every source seen once at least, the largest once: epochs = (largest share / share) ** (1 - exponent).
    floor = max(0.0, 1.0 - math.log(max_epochs) / (high - low))
    goal = target_entropy * math.log(count)
    begin, end = 0.0, 1.0
    for _ in range(PASSES):
        tried = [begin + (end - begin) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
        entropies = [math.log(z) - a * zl / z for a, (z, zl) in zip(tried, _scored(shares, tried))]
        enough = [a for a, h in zip(tried, entropies) if h >= goal]
        low_end = max(enough, default=begin)
        end = min([a for a in tried if a > low_end], default=end)
        begin = low_end
    at_one = _scored(shares, [1.0])[0]
    if math.log(at_one[0]) - at_one[1] / at_one[0] >= goal:
        begin = 1.0
    return max(begin, floor)


def source_plan(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
) -> DataFrame:
    """(source, tokens, share, weight, source_budget, epochs) from rows of (source, tokens).

    Without a ``budget``, it is the smallest that shows every source once; with one, sources may fall short of an
    epoch, and none is seen more than ``max_epochs`` times even if the budget is not used up.
    """
    totals = stage(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = (
        totals.where("tokens > 0")
        .withColumn("share", F.col("tokens") / F.lit(float(total)))
        .withColumn("log_share", F.log("share"))
    )
    exponent = bisected_exponent(shares, target_entropy, max_epochs)
    z = _scored(shares, [exponent])[0][0]
    weighted = shares.withColumn("weight", F.exp(F.col("log_share") * exponent) / F.lit(z or 1.0))
    if budget is None:
        most = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
        wanted = F.col("weight") * F.lit(float(most or 0.0))
    else:
        wanted = F.least(F.col("weight") * F.lit(float(budget)), F.col("tokens") * F.lit(float(max_epochs)))
    return weighted.withColumn("source_budget", F.round(wanted).cast("long")).select(
        "source",
        "tokens",
        "share",
        "weight",
        (F.greatest("source_budget", "tokens") if budget is None else F.col("source_budget")).alias("source_budget"),
    )


def _ticket(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _started(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``start``: the tokens of the blocks before it in its source, by (turn, block).

    Turns are hashes, so their leading bits part a source's blocks into ``2 ** RANGE_BITS`` like ranges. A block's start
    is that of its range plus what the range holds before it; no task orders all blocks of a source.
    """
    blocks = blocks.withColumn("range", F.shiftright("turn", 64 - RANGE_BITS))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        blocks.groupBy("source", "range")
        .agg(F.sum("block_tokens").alias("held"))
        .select(
            F.col("source").alias("s_source"),
            F.col("range").alias("s_range"),
            F.coalesce(F.sum("held").over(along), F.lit(0)).alias("range_start"),
        )
    )
    before = Window.partitionBy("source", "range").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("inside", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
        .join(ranges, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
        .withColumn("start", F.col("range_start") + F.col("inside"))
        .drop("range", "inside", "range_start", "s_source", "s_range")
    )


def mixed(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """Documents (doc_id, text, source, ...) to the rows of the mixture: doc_id, source, tokens, weight, epoch,
    block, ticket, turn. An epoch's permutation of a source's blocks is their order by turn; within a block, rows
    go by ticket.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``. A null source is a source of its own. Texts without tokens cost nothing
    and stand in the first epoch. The last document of a source's budget may go over it. Repeated rows count each for
    itself; other columns are ignored. An empty table gives no rows.
    """
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            _ticket(seed).alias("ticket"),
        ),
        "tokens",
    )
    plan = stage(source_plan(rows, target_entropy, max_epochs, budget), "plan")
    plan = plan.select(
        F.col("source").alias("p_source"), F.col("tokens").alias("source_tokens"), "weight", "source_budget"
    )
    known = rows.join(plan, rows.source.eqNullSafe(F.col("p_source")), "left").drop("p_source")
    blocks_of = (F.col("source_tokens") / BLOCK_TOKENS).cast("long") + 1
    known = known.withColumn("block", F.coalesce(F.pmod("ticket", blocks_of), F.lit(0)))
    known = known.withColumn("full", F.coalesce(F.expr("source_budget div source_tokens"), F.lit(0)))
    known = known.withColumn("rest", F.coalesce(F.expr("source_budget % source_tokens"), F.lit(0)))
    blocks = known.where("rest > 0").groupBy("source", "block", "full", "rest").agg(F.sum("tokens").alias("block_tokens"))

    def turn_of(epoch: str) -> Column:
        return F.xxhash64(F.lit(seed), epoch, "source", "block")

    reached = (
        _started(stage(blocks.withColumn("turn", turn_of("full")), "blocks"))
        .where("start < rest")
        .select(
            F.col("source").alias("r_source"),
            F.col("block").alias("r_block"),
            (F.col("rest") - F.col("start")).alias("left"),
            (F.col("start") + F.col("block_tokens") > F.col("rest")).alias("cut"),
        )
    )
    partial = known.where("tokens > 0").join(
        reached, known.source.eqNullSafe(F.col("r_source")) & (known.block == F.col("r_block"))
    )
    inside = Window.partitionBy("source", "block").orderBy("ticket", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        partial.where("cut")
        .withColumn("seen", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .where("seen < left")
        .drop("seen")
    )
    final = partial.where("not cut").unionByName(cut).withColumn("epoch", F.col("full"))
    epochs = F.when(F.col("tokens") > 0, F.col("full")).otherwise(F.lit(1))
    whole = known.withColumn(
        "epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0).cast("long"), epochs - 1)))
    )
    columns = ["doc_id", "source", "tokens", "weight", "epoch", "block", "ticket"]
    return whole.select(*columns).union(final.select(*columns)).withColumn("turn", turn_of("epoch"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture of :func:`mixed` holds it."""
    seed = settings.get("seed", 17)
    drawn = stage(mixed(docs, **settings).groupBy("ticket").agg(F.count("*").alias("times")), "drawn")
    rows = docs.select(F.struct("*").alias("row"), _ticket(seed).alias("ticket")).join(drawn, "ticket")
    alike = Window.partitionBy("ticket")
    at = F.row_number().over(alike.orderBy("ticket")) - 1
    rows = rows.withColumn("at", at).withColumn("n", F.count("*").over(alike))
    times = F.expr("times div n + cast(at < times % n as int)").cast("int")
    return rows.withColumn("turn", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select("row.*")
