from __future__ import annotations

import heapq
import random
import zlib
from collections import defaultdict

from llm import cases

from thermaline.llm import lpt_shards as module
from thermaline.llm import numbering
from thermaline.llm.lpt_shards import filled, lpt_shards


def checked(rows, shards):
    """The laws every result has to keep; returns the loads."""
    loads, slots, homes = [0] * shards, defaultdict(list), defaultdict(set)
    for row in rows:
        assert row.law == "bytes" and row.grown_shard is None
        loads[row.shard] += row["size"]
        slots[row.shard].append(row.slot)
        homes[(row["size"], row.text_crc32)].add(row.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    return loads


def test_awkward_rows(spark):
    texts = cases.awkward_texts()
    rows = lpt_shards(cases.documents(spark, texts), 5).collect()
    checked(rows, 5)
    want = sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr
    )
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want


def test_as_even_as_single_scheduling(spark, monkeypatch):
    monkeypatch.setattr(module, "HEAVY", 2)
    monkeypatch.setattr(numbering, "BLOCK_ROWS", 50)
    rng = random.Random(4)
    texts = [cases.prose(rng, rng.randrange(1, 400)) for _ in range(600)]
    loads = checked(lpt_shards(cases.documents(spark, texts), 7).collect(), 7)
    heap = [0] * 7
    for size in sorted((len(t) + 8 for t in texts), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert max(loads) - min(loads) <= (max(heap) - min(heap)) + 0.01 * sum(loads) / 7


def test_a_group_with_a_third_of_the_bytes_stays_together(spark):
    texts = ["hot text " * 30] * 100 + [f"{i} text " * 30 for i in range(200)]
    rows = lpt_shards(cases.documents(spark, texts), 4).collect()
    loads = checked(rows, 4)
    rest = sorted(loads)[:3]
    assert max(rest) - min(rest) <= 400


def test_fills_like_a_heap():
    rng = random.Random(0)
    for _ in range(200):
        loads = [rng.randrange(100) for _ in range(rng.randrange(1, 8))]
        size, count = rng.randrange(1, 30), rng.randrange(60)
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
        got = filled(loads, size, count)
        assert sum(got) == count
        assert sorted(a + n * size for a, n in zip(loads, got)) == sorted(load for load, _ in heap)


def test_empty_table(spark):
    assert lpt_shards(cases.empty(spark)).collect() == []
