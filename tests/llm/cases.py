"""Tables that hold the awkward cases every operator must take."""

from __future__ import annotations

import random

# Columns that operators use as names of their own.
CLASHING = [
    "id", "digest", "size", "shard", "slot", "bytes", "tokens", "ticket", "weight", "row", "at", "n", "text_key",
    "owner", "repository", "kind", "good", "label", "component", "anchor", "turn", "times", "band", "rep", "bit_set",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{name}` string" for name in CLASHING
)


def rows_of(texts, first: int = 0):
    """(doc_id, text) pairs with sources, one of which holds a third of the rows."""
    out = []
    for at, item in enumerate(texts):
        doc_id, text = item if isinstance(item, tuple) else (first + at, item)
        source = None if at % 17 == 16 else f"src{0 if at % 3 == 0 else at % 7}"
        out.append((doc_id, text, "en" if at % 2 else None, source, None, *["x"] * len(CLASHING)))
    return out


def documents(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward_texts(seed: int = 3):
    """Null and empty texts, blanks only, one word, very long, repeated rows and ids, null ids, copies, wide letters."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    texts = [None, "", " \n\t", "word", "Ünïcode ß 漢字 " * 20, base, base, base.upper(), prose(rng, 30_000)]
    texts += [prose(rng, rng.randrange(1, 150)) for _ in range(40)]
    for _ in range(20):
        words = base.split()
        for _ in range(rng.randrange(1, 30)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += ["a" * 700, "ab" * 300, "x " * 200]
    pairs = [(100 + at, text) for at, text in enumerate(texts)]
    return [*pairs, pairs[5], pairs[5], (None, base), (None, None), (105, "another text under a used id")]
