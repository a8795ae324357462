"""What a chain of filters removes, in every order of the filters.

A document is reduced to the set of filters that it fails. In a given order it is removed by the first filter of that
set. The permutations of n filters have ranks in lexicographic order, and those that begin with a given prefix are one
interval of (n - length)! ranks, which begins at the prefix's Lehmer rank. So a set's removals at a step by one filter
are a few intervals: one for each prefix of filters outside the set, followed by that filter. Counts are added where an
interval begins, taken away where it ends, and a running sum over the ranks gives the totals of all orders at once; no
document meets an order.

The sets of failed filters are counted first, so what is spread over the orders are at most 2**n rows for each part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.schema import small_table
from thermaline.staging import stage

#: Blanks between words, as the inside of a character class.
BLANKS = r"\x20\x09-\x0D"
COUNTS = ("n", "n_good", "n_toxic")


def lehmer_rank(prefix: Sequence[int], n: int) -> int:
    """The rank of the first permutation of 0..n-1 that begins with ``prefix``, in lexicographic order."""
    rank = 0
    for at, item in enumerate(prefix):
        smaller = sum(1 for other in range(item) if other not in prefix[:at])
        rank += smaller * factorial(n - 1 - at)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int, int]]:
    """(failed, step, filter, begin, end): the ranks in which a set of failed filters is removed there."""
    found = []
    for failed in range(1, 1 << n):
        outside = [item for item in range(n) if not failed >> item & 1]
        for before in range(len(outside) + 1):
            for prefix in permutations(outside, before):
                for item in range(n):
                    if failed >> item & 1:
                        begin = lehmer_rank([*prefix, item], n)
                        found.append((failed, before + 1, item, begin, begin + factorial(n - 1 - before)))
    return found


def text_filters(text: Column) -> list[tuple[str, Column]]:
    """The letters and failure conditions of the filters that look at one text; a null text is empty.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % of the characters are A-Z; D: holds one of
    ``#$%&*|``. An empty text fails A alone.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda word: word != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        ("A", F.size(words) < 200),
        ("B", 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)),
        ("C", 100 * capitals.cast("long") > 3 * F.length(text)),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


def failed_sets(docs: DataFrame, labels: DataFrame, filters: Sequence[Column], part: Column) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents of each set of failed filters; the last filter is that of copies.

    Bit i of ``failed`` stands for the i-th of ``filters``, the bit after them for copies: a document whose text an
    other document with a smaller doc_id has, whatever becomes of that one. Only one row of each text, the one with the
    smallest id, comes back to the others, by text and id together, so a text with very many copies is no hot key.
    """
    mask = F.lit(0)
    for bit, fails in enumerate(filters):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
            part.alias("part"),
            mask.cast("int").alias("failed"),
        ),
        "failed-sets",
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    first = first.withColumn("is_first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .join(known, "doc_id", "left")
        .withColumn("failed", F.col("failed") + F.when(copy, 1 << len(filters)).otherwise(0))
        .groupBy("part", "failed")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("n_good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("n_toxic"),
        )
    )


def order_audit(sets: DataFrame, names: str) -> DataFrame:
    """Every part's totals of each order and step: the columns of ``filter_audit``.

    ``sets`` has (part, failed, n, n_good, n_toxic); ``names`` holds one letter for each filter, in lexicographic
    order. A part without documents has no rows; every part in ``sets`` has all orders and steps, zeros included.
    """
    spark, size = sets.sparkSession, len(names)
    orders = ["".join(order) for order in permutations(names)]
    intervals = small_table(spark, removal_intervals(size), "failed int, step int, filter int, begin int, end int")
    sets = stage(sets.select("part", "failed", *COUNTS), "failed-counts")
    borders = sets.join(intervals, "failed").select(
        "part",
        "step",
        F.explode(
            F.array(
                F.struct(F.col("begin").alias("rank"), *[F.col(c).alias(c) for c in COUNTS]),
                F.struct(F.col("end").alias("rank"), *[(-F.col(c)).alias(c) for c in COUNTS]),
            )
        ).alias("border"),
    )
    borders = borders.groupBy("part", "step", "border.rank").agg(*[F.sum(f"border.{c}").alias(c) for c in COUNTS])
    places = small_table(
        spark,
        [(rank, order, at + 1, names.index(letter)) for rank, order in enumerate(orders) for at, letter in enumerate(order)],
        "rank int, filter_order string, step int, filter int",
    )
    failing = sets.select(
        "part",
        "n",
        "failed",
        F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("filter"),
    ).withColumn("fails", F.expr("failed & shiftleft(1, filter)") != 0)
    failing = failing.groupBy("part", "filter").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(F.col("fails"), F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.expr("failed = shiftleft(1, filter)"), F.col("n")).otherwise(0)).alias("unique_fails"),
    )
    grid = failing.join(places, "filter")
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    steps = Window.partitionBy("part", "rank").orderBy("step")
    by_filter = Window.partitionBy("part", "filter")
    totals = grid.join(borders, ["part", "step", "rank"], "left")
    for name, count in (("removed", "n"), ("good_lost", "n_good"), ("toxic_lost", "n_toxic")):
        totals = totals.withColumn(name, F.sum(F.coalesce(count, F.lit(0))).over(ranks))
    return totals.withColumn("kept", F.col("documents") - F.sum("removed").over(steps)).select(
        "part",
        "filter_order",
        "step",
        *[F.col(name).cast("long").alias(name) for name in ("kept", "removed")],
        (F.col("failing") - F.col("removed")).cast("long").alias("redundant"),
        *[F.col(name).cast("long").alias(name) for name in ("unique_fails", "good_lost", "toxic_lost")],
        F.sum("removed").over(by_filter).cast("long").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the corpus in all 120 orders: one row for each part, order and step.

    Columns: part, filter_order, step (from 1), kept after the step, removed by it, redundant (fail its filter, were
    removed before), unique_fails (fail its filter only), good_lost and toxic_lost (removed here, labelled so), shapley
    (removed by its filter in all orders together).

    ``docs`` has (doc_id, text, lang), ``labels`` (doc_id, quality, toxic); other columns are ignored. Parts are the
    languages, a null one is the empty string. A null text is an empty one. Of equal texts, the rows with the smallest
    doc_id are no copies, repeated rows with that id included; a null doc_id is never a copy, has no label, and makes
    nothing a copy. A document has a label if any of its label rows has it; label rows of unknown documents, nulls and
    repeated rows change nothing. An empty table gives no rows.
    """
    filters = text_filters(F.col("text"))
    sets = failed_sets(docs, labels, [fails for _, fails in filters], F.coalesce("lang", F.lit("")))
    return order_audit(sets, "".join(name for name, _ in filters) + "E")
