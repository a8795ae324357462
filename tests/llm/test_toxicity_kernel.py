from __future__ import annotations

import random
import zlib

import numpy as np
from llm import cases
from pyspark.sql import functions as F

from thermaline.llm import toxicity_kernel as tk

SF_DIR = "/root/testdata/sf0.01"


def never():
    return F.lit(False)


def slow_kernel(s, t):
    """All pairs of places of common subsequences of three letters."""
    def places(unit):
        codes = [tk._BEGIN, *(int(tk._CODE[b]) for b in unit), tk._END]
        out = []
        for i in range(len(codes)):
            for k in range(i + 2, min(i + tk.SPAN, len(codes))):
                for j in range(i + 1, k):
                    if codes[i] and codes[j] and codes[k]:
                        out.append(((codes[i], codes[j], codes[k]), k - i + 1))
        letters = max(3, sum(c > 0 for c in codes))
        norm = sum(
            max(0, letters - span + 1) * (span - 2) * tk.DECAY ** (2 * span) for span in range(3, tk.SPAN + 1)
        )
        return out, norm**0.5

    (a, na), (b, nb) = places(s), places(t)
    return sum(tk.DECAY ** (p + q) for x, p in a for y, q in b if x == y) / (na * nb)


def test_kernel_equals_the_sum_over_all_pairs_of_places():
    words = [b"idiot", b"i-d-i-o-t", b"idxiot", b"aaaa", b"", b"a", b"wh1ch", "é漢字".encode(), b"abcdefghijklmnopqrst"]
    got = tk.kernel(words, words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert np.isclose(got[i, j], slow_kernel(s, t)), (s, t)
    assert np.linalg.eigvalsh(got).min() > -1e-9


def test_the_table_has_the_values_of_the_kernel_sum():
    rng = random.Random(1)
    clean = ["".join(rng.choice("aeioulrstn") for _ in range(rng.randrange(2, 10))).encode() for _ in range(200)]
    table, bias = tk.fitted([b"idiot", b"moron", b"scumbag"], clean)
    values = tk.margins(*tk._encoded([b"idiot", b"moron", b"scumbag", *clean[:50]]), table, bias)
    assert values[:3].min() > 0 > np.median(values[3:])
    # Gapped and altered forms of what was learnt lie above the clean words.
    forms = [b"id-iot", b"i.d.i.o.t", b"idiiot", b"morxon", b"scuumbag"]
    assert tk.margins(*tk._encoded(forms), table, bias).min() > np.quantile(values[3:], 0.9)
    # Additivity: the table is linear in subsequences, as the kernel is.
    landmarks = [b"idiot", b"moron"]
    codes, stops = tk._encoded(landmarks)
    weights = np.zeros(tk.SYMBOLS**3)
    for owner, ids, weight in tk.subsequences(codes, stops):
        weights += weight * np.bincount(ids, weights=(np.array([2.0, -3.0]) / tk._norms(tk.letters_of(codes, stops)))[owner], minlength=len(weights))
    assert np.allclose(tk.margins(*tk._encoded(forms), weights, 0.0), tk.kernel(forms, landmarks) @ [2.0, -3.0])


def test_units():
    def split(*texts):
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)]).astype(np.int64)
        begins, ends, rows = tk.units(data, offsets)
        return [(int(r), data[b:e].tobytes().decode()) for b, e, r in zip(begins, ends, rows)]

    assert split("You, id-iot!", "", " ... ", "x y") == [(0, "You"), (0, "id-iot"), (3, "x"), (3, "y")]
    assert split("an i d i o t is", "a b") == [(0, "an"), (0, "i d i o t"), (0, "is"), (1, "a"), (1, "b")]
    assert split("a b", "c d") == [(0, "a"), (0, "b"), (1, "c"), (1, "d")]
    long = split("x" * 70)
    assert [len(unit) for _, unit in long] == [24, 24, 24, 24, 22]


def toxic_rows(n=600, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ba", "lo", "ri", "te", "un", "sha"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron,", "pathetic!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def scores(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    return rows


def test_unseen_documents_and_gapped_insults(spark):
    docs, labels = toxic_rows()
    new = [(1000, "sha te ba i d i o t lori P.a.t.h.e.t.i.c te"), (1001, "unba lori mo-ron patheetic te"), (1002, "te ba lori unsha riri")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 0
    rows = scores(tk.toxicity(cases.documents(spark, docs + new), table, held))
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.doc_id < 1000)
    assert {r.doc_id: r.predicted for r in rows if r.doc_id >= 1000} == {1000: 1, 1001: 1, 1002: 0}
    assert {r.doc_id for r in rows if r.held_out} == {i for i in [*range(600), 1000, 1001, 1002] if i % 3 == 0}


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels = toxic_rows(300)
    held = F.col("doc_id") % 3 == 0
    turned = [(i, 1 - t if i % 3 == 0 else t) for i, t in labels]
    got = [
        sorted(map(tuple, scores(tk.toxicity(cases.documents(spark, docs), spark.createDataFrame(rows, "doc_id long, toxic int"), held))))
        for rows in (labels, turned)
    ]
    assert got[0] == got[1]


def test_awkward_rows_and_empty_tables(spark):
    docs, labels = toxic_rows(300)
    odd = [(i, t) for i, t in cases.awkward_texts()]
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 1), (7, 0), (9999, 1)], "doc_id long, toxic int")
    rows = scores(tk.toxicity(cases.documents(spark, [*docs, *odd]), table, never()))
    assert len(rows) == len(docs) + len(odd)
    empty = {r.score for r in rows if r.doc_id in (100, 101, 102)}
    assert min(empty) < 0.5
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tk.toxicity(cases.empty(spark), none, never()).count() == 0
    assert {r.score for r in scores(tk.toxicity(cases.documents(spark, docs), none, never()))} == {0.5}
    one_kind = spark.createDataFrame([(i, 0) for i in range(98)], "doc_id long, toxic int")
    (score,) = {round(r.score, 9) for r in scores(tk.toxicity(cases.documents(spark, docs), one_kind, never()))}
    assert score == 0.01


def test_held_out_labels_of_the_driver_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = scores(tk.toxicity(docs, labels, held))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    known = [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    clean = [r.predicted for r, toxic in known if not toxic]
    toxic = [r.predicted for r, t in known if t]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)
