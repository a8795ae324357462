from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations
from math import factorial

from llm import cases

from thermaline.llm.filter_audit import filter_audit, lehmer_rank, removal_intervals

LABELS = "doc_id long, quality int, toxic int, n string"


def brute(docs, labels):
    """Every order on every document, one after the other."""
    known = defaultdict(lambda: [0, 0])
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            known[doc_id][0] |= quality == 1
            known[doc_id][1] |= toxic == 1
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    parts = defaultdict(list)
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            letter
            for letter, failed in {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": doc_id is not None and doc_id > first[text],
            }.items()
            if failed
        }
        parts[lang or ""].append((fails, *(known[doc_id] if doc_id is not None else (0, 0))))
    rows, shapley = {}, defaultdict(int)
    for part, found in parts.items():
        for order in permutations("ABCDE"):
            left = found
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = [d for d in found if letter in d[0]]
                rows[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    len(failing) - len(gone),
                    sum(d[0] == {letter} for d in found),
                    sum(d[1] for d in gone),
                    sum(d[2] for d in gone),
                ]
                shapley[part, letter] += len(gone)
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def found(df):
    rows = df.collect()
    assert df.columns[:3] == ["part", "filter_order", "step"]
    out = {tuple(row[:3]): tuple(row[3:]) for row in rows}
    assert len(out) == len(rows)
    return out


def test_ranks_are_those_of_sorted_permutations():
    orders = list(permutations(range(5)))
    assert [lehmer_rank(order, 5) for order in orders] == list(range(120))
    for prefix in [(3,), (1, 4), (4, 2, 0)]:
        begin = lehmer_rank(prefix, 5)
        held = [rank for rank, order in enumerate(orders) if order[: len(prefix)] == prefix]
        assert held == list(range(begin, begin + factorial(5 - len(prefix))))


def test_the_intervals_of_a_set_cover_each_order_once():
    for failed in range(1, 32):
        held = [rank for f, _, _, begin, end in removal_intervals(5) if f == failed for rank in range(begin, end)]
        assert sorted(held) == list(range(120))


def test_brute_force_on_awkward_tables(spark):
    texts = cases.awkward_texts() + [(900 + i, t) for i, t in enumerate(["PRICE $5 " * 250, "a#b", "A" * 40, "A" * 40, "x y " * 300])]
    docs = cases.documents(spark, texts)
    labels = [(100 + i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(101, 1, 1), (101, 0, None), (None, 1, 1), (5000, 1, 1), (904, None, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame([(*row, "x") for row in labels], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    assert found(filter_audit(docs, table)) == brute(rows, labels)


def test_a_hot_text_and_empty_tables(spark):
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text", "if(id % 2 = 0, 'en', '') as lang"
    )
    none = spark.createDataFrame([], LABELS)
    got = found(filter_audit(docs, none))
    rows = [tuple(r) for r in docs.collect()]
    assert got == brute(rows, [])
    assert filter_audit(cases.empty(spark), none).count() == 0
