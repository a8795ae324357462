from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm import cases

from thermaline.llm import phrase_mining
from thermaline.llm.phrase_mining import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs, longest):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    return f


def brute(docs, longest, least, top):
    out = []
    for lang, counts in occurrences(docs, longest).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, c in candidates.items()
            )
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df):
    return sorted(tuple(row) for row in df.collect())


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünü", "漢字", "don't", "a\x0bb"]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("en", "...!?"), ("", "one two"), ("en", "New York City. " * 200)]
    for i in range(150):
        text = [words[int(len(words) * rng.random() ** 2)] for _ in range(rng.randrange(1, 80))]
        for at in range(5, len(text), 9):
            text[at : at + 3] = ["New", "YORK", "City"] if i % 2 else ["old", "York"]
        rows.append((["en", "de", None][i % 3], "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in text)))
    return rows + rows[10:14]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_brute_force(spark, longest):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(collocations(docs, longest=longest, least=4, top=60)) == brute(rows, longest, 4, 60)


@pytest.mark.parametrize(("partitions", "shards", "slots"), [(1, 1, 64), (3, 4, 64), (2, 5, 1 << 16)])
def test_late_activation_and_shared_slots(spark, partitions, shards, slots):
    """A phrase that only occurs in one shard, words that become frequent in the last one, and very few slots."""
    rows = [("en", f"x{i} y{i} only here") for i in range(30)] + [("en", "late pair late pair " * 3)] * 4 + corpus()[:40]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1).repartition(partitions)
    counts = phrase_mining.phrase_counts(docs.fillna("und", ["lang"]).fillna("", ["text"]), 3, 5, shards, slots)
    exact = occurrences(rows, 3)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in counts.where("length > 0").collect()}
    assert {r.lang: r.n for r in counts.where("length = 0").collect()} == {
        lang: sum(n for p, n in f.items() if len(p) == 1) for lang, f in exact.items()
    }
    assert all(exact[lang][phrase] == n for (lang, phrase), n in got.items())
    assert {(lang, p) for lang, f in exact.items() for p, n in f.items() if n >= 5} <= set(got)


def test_phrases_that_cannot_be_frequent_are_not_counted(spark):
    rows = [("en", f"rare{i} word{i} pair{i}") for i in range(500)] + [("en", "often seen")] * 20
    docs = spark.createDataFrame(rows, "lang string, text string")
    counts = phrase_mining.phrase_counts(docs, 3, 10)
    assert {r.phrase for r in counts.where("length > 1").collect()} == {"often seen"}


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrase_mining, "GROUP_BYTES", 300)
    texts = ["alpha beta gamma. " * 500, "", "no end of it " * 400, "x" * 5000, "a. b", "c"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)]).astype(np.int64)
    got, last = [], None
    for words, piece, rows in phrase_mining.pieces(data, offsets):
        last = None
        for word, number, row in zip(words.to_pylist(), piece.tolist(), rows.tolist()):
            if (number, row) != last:
                got.append((row, []))
            got[-1][1].append(word.decode())
            last = (number, row)
    wanted = [(row, piece.split()) for row, text in enumerate(texts) for piece in text.split(".") if piece.split()]
    assert got == wanted


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 1, "a", 9_000_000_000_001), ("en", 1, "b", 8_000_000_000_003), ("en", 2, "a b", 7_000_000_000_007)],
        "lang string, length int, phrase string, n long",
    )
    (row,) = phrase_mining.scored_phrases(counts, 2, 10).collect()
    assert row.score == 1000000 * 7_000_000_000_007**2 // (9_000_000_000_001 * 8_000_000_000_003)


def test_awkward_and_empty_tables(spark):
    docs = cases.documents(spark, cases.awkward_texts())
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert found(collocations(docs)) == brute(rows, 3, 10, 2000)
    assert collocations(cases.empty(spark)).count() == 0


def test_bits_fold_modulo_the_smaller_size():
    bits = np.zeros(1024 // 64, dtype=np.int64)
    slots = [0, 63, 64, 511, 1023]
    for slot in slots:
        bits[slot >> 6] |= np.left_shift(np.int64(1), np.int64(slot & 63))
    for size in (64, 256, 1024):
        assert np.flatnonzero(phrase_mining.folded(bits, size)).tolist() == sorted({slot % size for slot in slots})


def test_sums_of_keys():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(58)
    found, sums = phrase_mining._summed(keys)
    assert dict(zip(found.tolist(), sums.tolist())) == Counter(keys.tolist())
    again = phrase_mining._summed(np.concatenate([found, found]), np.concatenate([sums, sums]))
    assert again[0].tolist() == found.tolist() and again[1].tolist() == (2 * sums).tolist()
    assert [len(array) for array in phrase_mining._summed(keys[:0])] == [0, 0]


def test_runs_take_a_few_bytes_a_key():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 300_000).astype(np.uint64))
    counts = rng.integers(1, 9, len(keys))
    batch = phrase_mining._runs(2, 0, keys, counts, 6)
    assert sum(len(blob) for column in batch.columns if pa.types.is_binary(column.type) for blob in column.to_pylist()) < 5 * len(keys)
    found = phrase_mining._values(batch)
    assert np.array_equal(found[0], keys) and np.array_equal(found[1], counts)
    part = phrase_mining._values(batch.slice(7, 20))
    begin, end = found[2][7], found[2][27]
    assert np.array_equal(part[0], keys[begin:end]) and np.array_equal(part[1], counts[begin:end])


def test_runs_of_the_widest_values():
    keys = np.array([0, 1, 255, 256, 65536, (1 << 36) - 1, 1 << 36, (1 << 40) - 1], dtype=np.uint64)
    counts = np.array([1, 255, 256, 1 << 24, (1 << 56) - 1, 1 << 56, (1 << 63) - 1, 3])
    batch = phrase_mining._runs(1, -1, keys, counts, 4)
    assert batch.column("bucket").to_pylist() == [0, 1, 15]
    found = phrase_mining._values(batch)
    assert found[0].tolist() == keys.tolist() and found[1].tolist() == counts.tolist()
    assert [len(array) for array in phrase_mining._values(batch.slice(0, 0))] == [0, 0, 1]


def test_spelled_phrases_travel_compressed_and_summed():
    rng = random.Random(6)
    texts = [f"word{rng.randrange(300)} word{rng.randrange(300)} ü" for _ in range(20_000)] + [""]
    lang, bucket = [i % 2 for i in range(len(texts))], [len(text) % 3 for text in texts]
    n = np.array([1 + i % 300 for i in range(len(texts))])
    phrase = pa.array([text.encode() for text in texts], pa.large_binary())
    batch = phrase_mining._texts(["en", "de"], 3, np.array(lang), np.array(bucket), phrase, n)
    wanted, got = Counter(), Counter()
    for row in zip(lang, bucket, texts, n.tolist()):
        wanted[("en", "de")[row[0]], row[1], row[2].encode()] += row[3]
    for row in batch.to_pylist():
        lines = phrase_mining._lines(pa.decompress(row["phrases"], row["size"], codec="zstd")).to_pylist()
        sums = phrase_mining._unpacked(pa.array([row["counts"]], pa.binary()), np.array([len(lines)])).tolist()
        assert lines == sorted(set(lines))
        got.update({(row["lang"], row["bucket"], line): count for line, count in zip(lines, sums)})
    assert got == wanted
    assert sum(len(row["phrases"]) for row in batch.to_pylist()) < sum(len(text) for _, _, text in wanted) / 2
