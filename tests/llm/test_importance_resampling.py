from __future__ import annotations

import random

import numpy as np
from llm import cases
from pyspark.sql import functions as F

from thermaline.llm.importance_resampling import resampled, top_threshold

LABELS = "doc_id long, quality int, toxic int"
SF_DIR = "/root/testdata/sf0.1"


def test_junk_goes_and_good_text_stays(spark):
    rng = random.Random(1)
    texts = [
        cases.prose(rng, 80) if i % 5 else " ".join(f"JUNK!!{rng.randrange(60)}" for _ in range(80))
        for i in range(500)
    ]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 500, 2)]
    df = cases.documents(spark, texts)
    kept = {r.doc_id for r in resampled(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == {i for i in range(500) if i % 5}


def test_held_out_labels_of_the_driver_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    fit = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    kept = resampled(docs, fit).select("doc_id", F.lit(1).alias("kept"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).join(kept, "doc_id", "left")
    shares = held.groupBy("quality", "toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {(r.quality, r.toxic): r.share for r in shares}
    assert share[1, 0] > 0.97 and share[0, 0] < 0.05
    # Toxic text of good quality: text whose toxic words are rare among the labels gets through.
    assert share[1, 1] < 0.4 and share[0, 1] < 0.05


def test_the_threshold_is_the_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-3, 6, 3000), np.zeros(500)])
    df = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(4)
    for k in (1, 7, 1500, 3499):
        at = top_threshold(df, "score", k)
        want = np.sort(values)[-k]
        assert (values >= at).sum() == (values >= want).sum()
    assert top_threshold(df, "score", 5000) == float("-inf")
    assert top_threshold(df, "score", 0) == float("inf")


def test_the_draw_follows_the_weights(spark):
    """With equal weights every document has the same chance; the draw depends on the seed alone."""
    texts = [f"same words {i % 3}" for i in range(300)]
    df = cases.documents(spark, texts)
    none = spark.createDataFrame([], LABELS)
    first, again, other = (
        {r.doc_id for r in resampled(df, none, 0.5, seed).collect()} for seed in (1, 1, 2)
    )
    assert first == again != other and len(first) == len(other) == 150


def test_awkward_rows_and_labels(spark):
    texts = cases.awkward_texts()
    labels = [(105, 1, 0), (105, 1, 0), (106, 1, None), (107, 0, 1), (107, 1, 1), (None, 1, 0), (99, 1, 0), (108, None, 0)]
    rows = resampled(cases.documents(spark, texts), spark.createDataFrame(labels, LABELS), 1.0).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_grams == 0 for r in rows) == sum(not (t or "").split() for _, t in texts)
    assert all(r.log_weight == 0 for r in rows if r.n_grams == 0)


def test_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert resampled(cases.empty(spark), labels).collect() == []
    df = cases.documents(spark, ["a b c", "d"])
    assert resampled(df, labels.limit(0)).count() == 2


def test_held_out_toxic_text_goes_and_clean_text_stays(spark):
    """A few words of long and short texts tell; labels hold noise, and one mislabelled text has many copies."""
    rng = random.Random(5)
    marks = [f"slur{i}" for i in range(6)]
    texts, toxic = [], []
    for i in range(600):
        words = cases.prose(rng, rng.choice([40, 80, 3000]), 400).split()
        toxic.append(i % 6 == 0)
        for _ in range(rng.choice([1, 2, 4]) if toxic[-1] else 0):
            words[rng.randrange(len(words))] = rng.choice(["{}", "{}.", "{}!!"]).format(rng.choice(marks)).upper()
        texts.append(" ".join(words))
    copied = cases.prose(rng, 60, 400) + " rareword"
    texts += [copied] * 30 + [cases.prose(rng, 60, 400) + " rareword " + cases.prose(rng, 5, 400) for _ in range(20)]
    labels = [(i, 1, int(toxic[i] or i % 40 == 1)) for i in range(600) if i % 4 > 1]
    labels += [(i, 1, 1) for i in range(600, 620)] + [(620, 1, None), (621, None, 1), (10_000, None, 1)]
    kept = {r.doc_id for r in resampled(cases.documents(spark, texts), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i in range(600) if i % 4 <= 1]
    assert sum(toxic[i] for i in held) > 40
    assert not [i for i in held if toxic[i] and i in kept]
    assert sum(i in kept for i in held if not toxic[i]) >= 0.9 * sum(not toxic[i] for i in held)
    assert sum(i in kept for i in range(630, 650)) >= 15


def test_held_out_toxic_labels_of_the_driver_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    fit = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    kept = resampled(docs, fit).select("doc_id", F.lit(1).alias("kept"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).join(kept, "doc_id", "left")
    held = held.join(docs, "doc_id").where("quality = 1")
    named = F.lower("text").rlike(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    rows = held.groupBy(named.alias("named"), "toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share"), F.count("*").alias("n"))
    share = {(r.named, r.toxic): r.share for r in rows.collect()}
    assert share[True, 1] < 0.02
    assert share[False, 0] > 0.97


def test_as_many_are_drawn_as_the_weights_say(spark):
    """An unlabelled source of junk holds a third of the rows, or unlabelled rows are all clean: no quota fits both."""
    rng = random.Random(8)
    good = [cases.prose(rng, rng.randrange(40, 120), 200) for _ in range(400)]
    junk = [" ".join(f"JUNK!!{rng.randrange(60)}" for _ in range(80)) for _ in range(240)]
    texts = good + junk
    labels = [(i, 1, 0) for i in range(0, 200)] + [(i, 0, 0) for i in range(400, 440)]
    labels = spark.createDataFrame(labels, LABELS)
    df = cases.documents(spark, texts)
    for rows, n_good in ((df, 400), (df.where("doc_id < 440"), 400), (df.where("doc_id < 150 or doc_id >= 400"), 150)):
        kept = {r.doc_id for r in resampled(rows, labels).collect()}
        assert not [i for i in kept if i >= 400]
        assert len(kept) >= 0.97 * n_good
    one_kind = {r.doc_id for r in resampled(df, labels.where("quality = 1")).collect()}
    assert len(one_kind) == len(texts)
