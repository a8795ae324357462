"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask slides over the words of a text and hashes only the words at its selected positions, so a substitution at an
ignored position leaves the hash as it is. Test and training texts that share a hash of the same mask are laid over
each other at that place, and the words of the overlap are compared one by one.

Training texts outnumber test texts by far, so most of their hashes are rejected where they arise, by a broadcast join
with the test hashes. Their number is checked first (``MAX_SENT``); a larger set is joined by shuffling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.staging import stage

# Fixed masks by the number of words of a test text (from, to). Each set finds every overlap that counts: whatever
# words of a window differ, as long as 80 % are equal, one of its masks has a place that selects equal words only.
# Of three or four words none may differ.
TIERS = (
    (3, 4, ("111",)),
    (5, 11, ("111", "1101")),
    (12, 2**31 - 1, ("110111", "11111")),
)
WINDOW = 16
PERCENT = 80
#: At most so many hashes of test texts, or places to compare (24 bytes each), are sent to every executor.
MAX_SENT = 1_000_000


# Code blocks of scripts written without spaces between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana,
# Han); each of their characters counts as a word. Ranges are much faster to match than names of scripts.
UNSPACED = (
    r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
)


def _words(text: Column) -> Column:
    lower = F.lower(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    spaced = F.when(ascii_only, lower).otherwise(F.regexp_replace(lower, f"([{UNSPACED}])", " $1 "))
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda word: word != "")


def _hashed(text: Column) -> Column:
    return F.transform(_words(text), lambda word: F.xxhash64(word))


def _at_places(
    rows: DataFrame, keys: Sequence[str], words: str, masks: Sequence[str], known: DataFrame | None = None
) -> DataFrame:
    """(keys, at, mask, seed): the seeds of ``masks`` at all places of the array ``words``.

    Places leave the array as rows of the few words that a mask spans, so a row stays small however long the text is,
    and everything after it is generated code. With ``known`` (mask, seed), a table of a checked size, only seeds that
    it has are kept.
    """
    span = max(len(mask) for mask in masks)
    following = [F.slice(words, i + 1, F.size(words)).alias(f"w{i}") for i in range(span)]
    placed = rows.select(*keys, F.posexplode_outer(F.arrays_zip(*following)).alias("at", "w"))
    seeds = []
    for n, mask in enumerate(masks):
        picked = [F.col(f"w.w{i}") for i, bit in enumerate(mask) if bit == "1"]
        inside = F.col(f"w.w{len(mask) - 1}").isNotNull()
        seeds.append(F.when(inside, F.xxhash64(*picked)).alias(f"seed_{n}"))
    placed = placed.select(*keys, "at", *seeds)
    kept = [F.col(f"seed_{n}").isNotNull() for n in range(len(masks))]
    if known is not None:
        for n, mask in enumerate(masks):
            own = known.where(F.col("mask") == mask).select(F.col("seed").alias(f"known_{n}")).distinct()
            placed = placed.join(F.broadcast(own), F.col(f"seed_{n}") == F.col(f"known_{n}"), "left")
        kept = [F.col(f"known_{n}").isNotNull() for n in range(len(masks))]
        placed = placed.where(F.expr(" or ".join(f"known_{n} is not null" for n in range(len(masks)))))
    each = [
        F.when(keep, F.struct(F.lit(mask).alias("mask"), F.col(f"seed_{n}").alias("seed")))
        for n, (mask, keep) in enumerate(zip(masks, kept))
    ]
    return (
        placed.select(*keys, "at", F.explode(F.array(*each)).alias("s"))
        .where("s is not null")
        .select(*keys, "at", "s.mask", "s.seed")
    )


def _best_window(doc: Column, item: Column, shift: Column) -> Column:
    """The most equal words of any window of the item laid over the document, and the item's word it begins at
    (negated). A window has ``WINDOW`` words, or all of a shorter item's.
    """
    width = F.least(F.lit(WINDOW), F.size(item))
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(item), F.size(doc) - shift)
    equal = F.transform(
        F.when(high > low, F.sequence(low, high - 1)),
        lambda at: F.when(F.get(item, at) == F.get(doc, at + shift), 1).otherwise(0),
    )
    starts = F.when(high - low >= width, F.sequence(F.lit(1), high - low - width + 1))
    return F.array_max(
        F.transform(
            starts,
            lambda start: F.struct(
                F.aggregate(F.slice(equal, start, width), F.lit(0), lambda sum_, x: sum_ + x).alias("matched"),
                (-(start - 1 + low)).alias("back"),
            ),
        )
    )


def _whole_documents(hashed: DataFrame, tiny: DataFrame) -> DataFrame:
    """(doc_id, item_id, b) of the documents that have the words of an item and no others."""
    n_words = F.size("doc")
    zero = F.lit(0)
    equal = hashed.where(n_words < TIERS[0][0]).join(tiny, F.col("doc") == F.col("item"))
    return equal.select(
        "doc_id",
        "item_id",
        F.struct(n_words.alias("matched"), zero.alias("back"), zero.alias("shift"), n_words.alias("n_words")).alias("b"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of documents (doc_id, text, ...) with benchmark items (item_id, text, ...).

    Returns one row for each document and item: doc_id, item_id, doc_word and item_word (where the best window begins,
    in words from 0), n_words (its length) and n_matched. A window of 16 words, or a whole shorter item, counts when
    at least 80 % of its words are equal, in any spelling of case and punctuation; of items of three or four words, all
    must be. Items of one or two words are too common in other texts to tell: they count where they are the whole
    document. Each character of a script without spaces is a word. Null or empty texts, texts without words and rows
    without an id are ignored. Rows that share a doc_id count as one document, and its best overlap is returned;
    likewise for items. Other columns are ignored.
    """
    items = stage(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashed("text").alias("item"))
        .where("item_id is not null")
        .where(F.size("item") > 0),
        "items",
    )
    seeds, masks = None, []
    for low, high, of_tier in TIERS:
        tier = items.where(F.size("item").between(low, high))
        found = _at_places(tier, ["item_id"], "item", of_tier)
        seeds = found if seeds is None else seeds.union(found)
        if not tier.isEmpty():
            masks += [mask for mask in of_tier if mask not in masks]
    masks = masks or list(TIERS[-1][2])
    seeds = stage(seeds.withColumnRenamed("at", "item_at"), "seeds")
    # A test set of a checked size is sent along to where the training hashes arise; of a larger one, all hashes of the
    # training texts meet it in the join below.
    known = seeds if seeds.count() <= MAX_SENT else None
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    hashed = texts.select("doc_id", _hashed(F.col("text")).alias("doc"))
    hits = _at_places(hashed, ["doc_id"], "doc", masks, known)
    places = stage(
        hits.join(seeds, ["mask", "seed"])
        .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct(),
        "places",
    )
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift")).alias("places"))
    if places.count() <= MAX_SENT:
        by_doc = F.broadcast(by_doc)
    laid = (
        texts.join(by_doc, "doc_id")
        .select("doc_id", _hashed(F.col("text")).alias("doc"), F.explode("places").alias("p"))
        .select("doc_id", "doc", "p.item_id", "p.shift")
        .join(items, "item_id")
        .select(
            "doc_id",
            "item_id",
            "shift",
            F.least(F.lit(WINDOW), F.size("item")).alias("n_words"),
            _best_window(F.col("doc"), F.col("item"), F.col("shift")).alias("best"),
        )
        .where(F.col("best.matched") * 100 >= F.col("n_words") * PERCENT)
        .select(
            "doc_id",
            "item_id",
            F.struct("best.matched", "best.back", (-F.col("shift")).alias("shift"), "n_words").alias("b"),
        )
    )
    tiny = items.where(F.size("item") < TIERS[0][0])
    if not tiny.isEmpty():
        laid = laid.unionByName(_whole_documents(hashed, tiny))
    return laid.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).select(
        "doc_id",
        "item_id",
        (-F.col("b.back") - F.col("b.shift")).cast("int").alias("doc_word"),
        (-F.col("b.back")).cast("int").alias("item_word"),
        F.col("b.n_words").alias("n_words"),
        F.col("b.matched").alias("n_matched"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id has no overlap with the benchmark; null ids stay."""
    found = stage(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti")
