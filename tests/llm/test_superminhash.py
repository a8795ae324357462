from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from llm import cases

from thermaline.llm.components import components
from thermaline.llm.superminhash import POSITIONS, near_duplicates, signature

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(text, words) for _, text in rows]
    parent = {doc_id: doc_id for doc_id, _ in rows if doc_id is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, common = rows[j][0], len(sets[i] & sets[j])
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for (doc_id, _), found in zip(rows, sets):
        component = None if doc_id is None else top(doc_id)
        out.append((doc_id, len(found), component, component == doc_id))
    return sorted(out, key=repr)


def found(df, words, percent):
    return sorted(map(tuple, near_duplicates(df, words, percent).collect()), key=repr)


def test_like_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for doc_id in range(250):
        kind = rng.random()
        if kind < 0.5 and rows:
            words = (rng.choice(rows[:15])[1] or "").split()
            for _ in range(rng.randrange(8)):
                if words:
                    words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            text = ("\n" if rng.random() < 0.5 else " ").join(words)
            text = text.upper() if rng.random() < 0.3 else text
        elif kind < 0.6:
            text = rng.choice([None, "", " \n"])
        elif kind < 0.8:
            text = " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(1, 5)))
        else:
            text = cases.prose(rng, rng.randrange(5, 250))
        rows.append((doc_id, text))
    df = cases.documents(spark, rows)
    assert found(df, 3, 85) == brute(rows, 3, 85)
    assert found(df, 5, 80) == brute(rows, 5, 80)


def test_a_large_group_of_near_copies_without_its_origin(spark):
    rng = random.Random(5)
    base = cases.prose(rng, 150, 5000).split()
    rows = []
    for doc_id in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((doc_id, " ".join(words)))
    assert found(cases.documents(spark, rows), 3, 85) == brute(rows, 3, 85)


def test_awkward_rows(spark):
    rows = [item for item in cases.awkward_texts() if len(item[1] or "") < 50_000]
    assert found(cases.documents(spark, rows), 3, 85) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(cases.empty(spark)).collect() == []


def test_signatures_estimate_the_similarity_and_both_ways_agree():
    rng = np.random.default_rng(1)
    errors = []
    for size in (40, 95, 96, 2000):
        common = rng.integers(0, 2**63, size).astype(np.uint64)
        own = [rng.integers(0, 2**63, size // 4).astype(np.uint64) for _ in range(2)]
        a, b = (signature(np.concatenate([common, x])) for x in own)
        errors.append(abs((a == b).mean() - size / (size + 2 * (size // 4))))
        assert sorted(a.tolist()) and len(a) == POSITIONS
    assert max(errors) < 0.2
    many = rng.integers(0, 2**63, 500).astype(np.uint64)
    least = np.minimum.reduce([signature(part) for part in np.array_split(many, 10)])
    assert (least == signature(many)).all()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert set(got.values()) == {0, 1000}
    groups = defaultdict(int)
    for component in got.values():
        groups[component] += 1
    assert dict(groups) == {0: 201, 1000: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
