"""Connected components of links held in tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.staging import stage

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (child > parent).

    Each step only needs the smallest neighbour of a vertex, an aggregate that is combined before it is
    shuffled; a vertex with very many links costs one row of the aggregate, and the join that brings the
    smallest neighbour back to its links is one that adaptive execution splits.
    """
    both = edges.union(edges.select(F.col("parent"), F.col("child"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("child"), F.col("m").alias("parent"))
        .distinct()
    )
    least = large.groupBy(F.col("child").alias("u")).agg(F.min("parent").alias("m"))
    small = large.withColumnRenamed("child", "u").join(least, "u")
    return (
        small.select(
            F.when(F.col("parent") == F.col("m"), F.col("u")).otherwise(F.col("parent")).alias("child"),
            F.col("m").alias("parent"),
        )
        .where("child > parent")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of ``links`` (a, b); the component is its smallest vertex.

    Rounds are written tables, so a lost executor repeats one round at most. Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest chain. An empty input gives no row.
    """
    edges = stage(
        links.select(
            F.greatest("a", "b").cast("long").alias("child"),
            F.least("a", "b").cast("long").alias("parent"),
        )
        .where("child > parent")
        .distinct(),
        "links",
    )

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count("*"),
                F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")),
            ).first()
        )

    before = state(edges)
    for _ in range(MAX_ROUNDS):
        edges = stage(_stars(edges), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("child").alias("vertex"), F.col("parent").alias("component")).union(
        edges.select(F.col("parent").alias("vertex"), F.col("parent").alias("component")).distinct()
    )
