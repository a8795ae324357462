from __future__ import annotations

import random
from collections import Counter

import pytest
from llm import cases

import __spark_entry__ as entry_module
import corpus_pipeline
from llm.test_spaced_seeds import overlaps, words
from llm.test_superminhash import brute as near_brute
from thermaline.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """Tables with junk, near copies, leaks, null ids and texts, and clashing columns."""
    rng = random.Random(6)
    good = [cases.prose(rng, rng.randrange(20, 120), 300) for _ in range(150)]
    texts = list(good)
    for i in range(40):
        copy = good[i].split()
        if i % 2:
            copy[len(copy) // 2] = "changed"
        texts.append(" ".join(copy))
    items = [cases.prose(rng, 24, 5000) for _ in range(4)]
    texts += [f"{cases.prose(rng, 40, 300)} {items[i % 4]} {cases.prose(rng, 20, 300)}" for i in range(12)]
    texts += [" ".join(f"JUNK!!{rng.randrange(40)}" for _ in range(60)) for _ in range(30)]
    texts += [None, "", (None, "a text without an id " * 3), (3, good[3])]
    cases.documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 202), 0) for i in range(0, 232, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_each_stage_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for at, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{at}"
        function(spark, before, folder).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "sharding":
            assert after.columns == docs.columns
        old, new = rows(before), rows(after) if name != "sharding" else None
        pairs = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality":
            assert not new - old
            assert all("JUNK" not in (text or "") for _, text, _ in new)
            assert sum(new.values()) >= 0.95 * sum("JUNK" not in (t or "") for _, t in pairs)
        elif name == "near_dedup":
            kept = {doc_id for doc_id, _, _, keeps in near_brute(pairs, 5, 80) if keeps or doc_id is None}
            assert new == Counter({k: n for k, n in old.items() if k[0] in kept})
        elif name == "decontamination":
            items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

            def leaks(text):
                return any(100 * best >= 80 * width for best, width in (overlaps(words(text), i) for i in items))

            bad = {doc_id for doc_id, text in pairs if doc_id is not None and leaks(text)}
            assert bad and new == Counter({k: n for k, n in old.items() if k[0] not in bad})
        elif name == "mixing":
            assert set(new) == set(old) and not old - new
            assert sum(new.values()) > sum(old.values())
        else:
            assert Counter(r.doc_id for r in after.collect()) == Counter(doc_id for doc_id, _ in pairs)
            assert set(r.shard for r in after.collect()) <= set(range(24))
        before = after


def test_run_applies_the_stages(spark):
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert result.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]


def test_all_are_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and set(queries.registered()) <= names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
