from __future__ import annotations

import itertools
import random
import re

from llm import cases

from thermaline.llm import spaced_seeds
from thermaline.llm.spaced_seeds import contaminated, decontaminated

ITEMS = "item_id long, text string, doc_id string"


UNSPACED = re.compile("([\u3040-\u30ff\u3400-\u9fff\u0e01-\u0e30])")


def words(text):
    return [w for w in re.split(r"[\W_]+", UNSPACED.sub(r" \1 ", (text or "").lower())) if w]


def overlaps(doc, item):
    """The most equal words of any window, over all ways to lay one text on the other."""
    width, best = min(spaced_seeds.WINDOW, len(item)), 0
    for shift in range(-len(item), len(doc)):
        for start in range(len(item) - width + 1):
            if 0 <= start + shift and start + shift + width <= len(doc):
                best = max(best, sum(item[start + i] == doc[start + shift + i] for i in range(width)))
    return best, width


def test_the_masks_lose_no_overlap():
    for low, high, masks in spaced_seeds.TIERS:
        for size in range(low, min(high, spaced_seeds.WINDOW) + 1):
            for missed in itertools.combinations(range(size), size * (100 - spaced_seeds.PERCENT) // 100):
                assert any(
                    not any(bit == "1" and at + i in missed for i, bit in enumerate(mask))
                    for mask in masks
                    for at in range(size - len(mask) + 1)
                )


def test_short_items_and_scripts_without_spaces(spark):
    rng = random.Random(12)
    items = ["four words of it", "Three, other WORDS", "two words", "one", "机器学习是什么意思", "今日はとても良い天気ですね", "สวสดครบ"]
    texts = [f"{cases.prose(rng, 8)} {item.upper()}; {cases.prose(rng, 8)}" for item in items]
    texts += [*items, "Two -- WORDS!", "four words of", "four other of it", "words three other", "ONE.", "one one"]
    texts += ["机器学习是怎么意思", "机器人是什么东西", f"他说{items[4]}啊", "今日はとても良い天気でした", "ones", "", None, "?"]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*items, "", "?!", None])], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in contaminated(cases.documents(spark, texts), benchmark).collect()}
    for doc_id, text in enumerate(texts):
        for item_id, item in enumerate(items):
            best, width = overlaps(words(text), words(item))
            whole = len(words(item)) > 2 or words(item) == words(text)
            if whole and 100 * best >= 80 * width:
                row = got.pop((doc_id, item_id))
                assert (row.n_matched, row.n_words) == (best, width)
                laid = words(text)[row.doc_word : row.doc_word + width]
                assert sum(a == b for a, b in zip(laid, words(item)[row.item_word :])) == best
    assert got == {}


def planted(rng, items):
    rows = []
    for doc_id in range(60):
        text = cases.prose(rng, rng.randrange(0, 60), 3000)
        kind = rng.random()
        if kind < 0.6:
            passage = rng.choice(items).split()
            if kind < 0.3:
                for at in range(4, len(passage), rng.choice([6, 9])):
                    passage[at] = f"other{rng.randrange(100)}"
            elif kind < 0.4:
                passage = passage[: len(passage) // 3]
            text += "\n" + " ".join(passage).upper() + "! " + cases.prose(rng, 10, 3000)
        rows.append((doc_id, text))
    return rows


def test_like_brute_force_with_substitutions(spark):
    rng = random.Random(8)
    items = [cases.prose(rng, n, 3000) for n in (3, 4, 5, 7, 9, 11, 12, 20, 30, 60)]
    rows = planted(rng, items)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id): r for r in contaminated(cases.documents(spark, rows), benchmark).collect()}
    for doc_id, text in rows:
        for item_id, item in enumerate(items):
            best, width = overlaps(words(text), words(item))
            if 100 * best >= 80 * width:
                row = got.pop((doc_id, item_id))
                assert (row.n_matched, row.n_words) == (best, width)
                pairs = zip(words(text)[row.doc_word :], words(item)[row.item_word : row.item_word + width])
                assert sum(a == b for a, b in pairs) == best
    assert got == {}


def test_a_test_set_too_large_to_send_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "MAX_SENT", 0)
    rng = random.Random(9)
    items = [cases.prose(rng, 20, 3000) for _ in range(5)]
    rows = [(i, cases.prose(rng, 20, 3000) + " " + (items[i % 5] if i % 2 else "")) for i in range(20)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in contaminated(cases.documents(spark, rows), benchmark).collect()}
    assert got == {(i, i % 5) for i in range(1, 20, 2)}


def test_awkward_rows(spark):
    texts = cases.awkward_texts()
    base = texts[5][1]
    benchmark = spark.createDataFrame(
        [(1, base, "x"), (1, base, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, base, "x"), (5, "漢字 ünïcode SS ß " * 6, "x")],
        ITEMS,
    )
    df = cases.documents(spark, texts)
    got = {(r.doc_id, r.item_id) for r in contaminated(df, benchmark).collect()}
    want = set()
    for doc_id, text in texts:
        best, width = overlaps(words(text)[:400], words(base))
        if doc_id is not None and 100 * best >= 80 * width:
            want.add((doc_id, 1))
    assert got == want and want
    left = decontaminated(df, benchmark)
    assert left.columns == df.columns
    ids = {doc_id for doc_id, _ in want}
    assert left.count() == sum(doc_id not in ids for doc_id, _ in texts)


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six", "x")], ITEMS)
    assert contaminated(cases.empty(spark), benchmark).collect() == []
    assert contaminated(cases.documents(spark, ["a b c d e f"]), benchmark.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six", "x")], ITEMS)
    plan = contaminated(cases.documents(spark, ["one two"]), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
