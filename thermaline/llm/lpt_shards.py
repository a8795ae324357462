"""Shards of nearly equal bytes by longest-processing-time scheduling of groups that stay together.

The groups, largest first, go to the least-loaded shard through a heap. Groups of at least
1 / (shards * ``HEAVY``) of all bytes, of which there are at most shards * ``HEAVY``, are scheduled one by one. All
smaller ones are scheduled by size class: sizes that agree in their nine leading bits, so at most
``MAX_CLASSES`` classes whatever the number of groups. What the heap does with n groups of one size is known in
closed form: it fills the shards to a common level and deals the last few singly. The driver thus sees a bounded
histogram, never the groups; each group finds its shard by its number within its class.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.numbering import numbered
from thermaline.staging import stage

HEAVY = 256
LEADING_BITS = 9
MAX_CLASSES = 64 << LEADING_BITS
ROW_BYTES = 8


def filled(loads: Sequence[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one ``size`` each shard gets from the least-loaded-first rule."""

    def counts(level: int) -> list[int]:
        return [max(0, level - load) // size for load in loads]

    low, high = min(loads), max(loads) + size * (count + 1)
    while low < high:
        middle = (low + high + 1) // 2
        if sum(counts(middle)) <= count:
            low = middle
        else:
            high = middle - 1
    given = counts(low)
    heap = [(load + n * size, shard) for shard, (load, n) in enumerate(zip(loads, given))]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, shard = heap[0]
        given[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return given


def schedule(
    heavy: Sequence[tuple[object, int]], classes: Sequence[tuple[int, int, int]], shards: int
) -> tuple[dict[object, int], dict[int, list[int]]]:
    """Shards of heavy groups (key, bytes) and, for each class (class, groups, bytes), the counts by shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed: dict[object, int] = {}
    for key, size in sorted(heavy, key=lambda item: (-item[1], bytes(item[0]))):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    loads = [load for load, _ in sorted(heap, key=lambda item: item[1])]
    dealt: dict[int, list[int]] = {}
    for name, count, total in sorted(classes, key=lambda item: -(item[2] / item[1])):
        size = max(1, round(total / count))
        dealt[name] = filled(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, dealt[name])]
    return placed, dealt


def lpt_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents (doc_id, text, ...) to (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The size is the UTF-8 bytes of the text plus 8; equal texts are one group, and a null text counts as an empty
    one. Repeated rows keep a slot each. Slots run from 0 without gaps in each shard. ``law`` is 'bytes': shards of
    nearly equal size, as near as the largest group lets them be. ``grown_shard`` is null, as this law moves rows
    freely when a shard is added. A null doc_id is a row like any other; other columns are ignored. An empty table
    gives no rows.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group_key"),
        ),
        "sizes",
    )
    bits = F.length(F.bin("bytes"))
    shift = F.greatest(bits - LEADING_BITS, F.lit(0))
    groups = stage(
        rows.groupBy("group_key")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .withColumn("class", (shift * (1 << LEADING_BITS) + F.expr(f"shiftright(bytes, greatest(length(bin(bytes)) - {LEADING_BITS}, 0))")).cast("int")),
        "groups",
    )
    whole = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    total, n_rows, n_groups = (int(x or 0) for x in whole)
    least = max(1, total // (shards * HEAVY))
    is_heavy = F.col("bytes") >= least
    heavy = [(bytes(r[0]), r[1]) for r in groups.where(is_heavy).select("group_key", "bytes").toLocalIterator()]
    light = groups.where(~is_heavy)
    classes = [
        tuple(r) for r in light.groupBy("class").agg(F.count("*"), F.sum("bytes")).toLocalIterator()
    ]
    placed, dealt = schedule(heavy, classes, shards)
    heavy_shards = spark.createDataFrame(
        [(bytearray(key), shard) for key, shard in placed.items()], "group_key binary, shard int"
    )
    ends = []
    for name, counts in dealt.items():
        upto, bounds = 0, []
        for n in counts:
            upto += n
            bounds.append(upto)
        ends.append((name, bounds))
    class_ends = spark.createDataFrame(ends, "class int, ends array<long>")
    light_shards = (
        numbered(light.select("group_key", "class"), ["class"], ["group_key"], "at", n_groups)
        .join(class_ends, "class")
        .select("group_key", F.expr("cast(size(filter(ends, e -> e <= at)) as int)").alias("shard"))
    )
    sharded = stage(rows.join(heavy_shards.union(light_shards), "group_key"), "sharded")
    return numbered(sharded, ["shard"], ["doc_id", "group_key"], "slot", n_rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
