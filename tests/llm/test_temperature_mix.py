from __future__ import annotations

import math
from collections import Counter

import pytest
from llm import cases
from pyspark.sql import functions as F

from thermaline.llm import temperature_mix
from thermaline.llm.temperature_mix import mixed, mixed_documents, source_plan


def planned(spark, tokens, **settings):
    df = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    args = {"target_entropy": 0.95, "max_epochs": 4.0} | settings
    return {r.source: r for r in source_plan(df, **args).collect()}


def bisected(shares, goal):
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum(p**a for p in shares)
        entropy = -sum(p**a / z * math.log(p**a / z) for p in shares)
        low, high = (a, high) if entropy >= goal else (low, a)
    return low


def test_weights_reach_the_target_entropy(spark):
    tokens = {"a": 5000, "b": 900, "c": 800, "d": 700}
    plan = planned(spark, tokens, max_epochs=100.0)
    shares = [t / 7400 for t in tokens.values()]
    a = bisected(shares, 0.95 * math.log(4))
    z = sum(p**a for p in shares)
    for (name, _), p in zip(tokens.items(), shares):
        assert plan[name].weight == pytest.approx(p**a / z, abs=1e-6)


def test_the_repetition_limit_bounds_the_exponent(spark):
    plan = planned(spark, {"a": 90_000, "b": 100, "c": 100}, max_epochs=3.0)
    assert plan["a"].source_budget == 90_000
    assert plan["b"].source_budget == pytest.approx(300, abs=1)


def test_equal_and_single_sources_keep_their_shares(spark):
    assert {r.source_budget for r in planned(spark, {"a": 10, "b": 10}).values()} == {10}
    assert planned(spark, {None: 10})[None].source_budget == 10


def test_a_budget_is_kept_per_source(spark):
    texts = [f"{i} " + "w " * (i % 50) for i in range(400)]
    df = cases.documents(spark, texts)
    rows = mixed(df, budget=3000).collect()
    plan = {r.source: r for r in source_plan(_counted(df), budget=3000).collect()}
    used = Counter()
    for row in rows:
        used[row.source] += row.tokens
    for source, row in plan.items():
        assert row.source_budget <= used[source] < row.source_budget + 60
    assert Counter((r.doc_id, r.epoch) for r in rows).most_common(1)[0][1] == 1


def _counted(df):
    return df.select("source", F.regexp_count("text", F.lit(temperature_mix.WORD)).alias("tokens"))


def test_epochs_are_whole_but_the_last_whose_blocks_come_in_turn(spark, monkeypatch):
    monkeypatch.setattr(temperature_mix, "BLOCK_TOKENS", 200)
    df = cases.documents(spark, [f"{i} " + "w " * (i % 50) for i in range(400)])
    rows = mixed(df).collect()
    by_source = {}
    for row in rows:
        by_source.setdefault(row.source, {}).setdefault(row.epoch, []).append(row)
    for epochs in by_source.values():
        whole = {r.doc_id for r in epochs[0]}
        last = max(epochs)
        for epoch, drawn in epochs.items():
            ids = [r.doc_id for r in drawn]
            assert len(ids) == len(set(ids))
            if epoch < last:
                assert set(ids) == whole
        if last:
            turns = sorted({r.turn for r in epochs[last]})
            for turn in turns[:-1]:
                block = next(r.block for r in epochs[last] if r.turn == turn)
                assert {r.doc_id for r in epochs[last] if r.turn == turn} == {
                    r.doc_id for r in epochs[0] if r.block == block
                }


@pytest.mark.parametrize("budget,bits", [(None, 12), (2500, 3), (20_000, 1)])
def test_drawn_rows_like_brute_force(spark, monkeypatch, budget, bits):
    monkeypatch.setattr(temperature_mix, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(temperature_mix, "RANGE_BITS", bits)
    df = cases.documents(spark, [f"{i} " + "w " * (i * 7 % 50) for i in range(500)])
    tokens = _counted(df)
    plan = {r.source: r for r in source_plan(tokens, budget=budget).collect()}
    keyed = df.select(
        F.col("doc_id"), "source", F.regexp_count("text", F.lit(temperature_mix.WORD)).alias("tokens"), temperature_mix._ticket(17).alias("ticket")
    ).collect()
    places = set()
    for row in keyed:
        n_blocks = plan[row.source].tokens // 150 + 1
        places.add((row.source, plan[row.source].source_budget // plan[row.source].tokens, row.ticket % n_blocks))
    turns = spark.createDataFrame(sorted(places, key=str), "source string, full long, block long")
    turns = turns.withColumn("turn", F.xxhash64(F.lit(17), "full", "source", "block")).collect()
    turn = {(r.source, r.block): r.turn for r in turns}
    want = Counter()
    for source, row in plan.items():
        n_blocks = row.tokens // 150 + 1
        own = [r for r in keyed if r.source == source]
        full, rest = divmod(row.source_budget, row.tokens)
        want.update((r.doc_id, epoch) for r in own for epoch in range(full))
        own.sort(key=lambda r: (turn[source, r.ticket % n_blocks], r.ticket % n_blocks, r.ticket))
        for r in own:
            if rest > 0:
                want[r.doc_id, full] += 1
            rest -= r.tokens
    assert Counter((r.doc_id, r.epoch) for r in mixed(df, budget=budget).collect()) == want


def test_awkward_rows_are_all_there(spark):
    texts = cases.awkward_texts()
    df = cases.documents(spark, texts)
    rows = mixed(df).where("epoch = 0").collect()
    assert Counter(r.doc_id for r in rows) == Counter(doc_id for doc_id, _ in texts)
    again = mixed_documents(df)
    assert again.columns == df.columns
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in mixed(df).collect())


def test_empty_table(spark):
    assert mixed(cases.empty(spark)).collect() == []
    assert mixed_documents(cases.empty(spark)).collect() == []
