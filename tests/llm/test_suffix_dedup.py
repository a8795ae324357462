from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm import cases

from thermaline.llm import suffix_dedup
from thermaline.llm.suffix_dedup import multikey_order, remove_repeats


def brute(rows, length=100):
    def age(doc_id):
        return -(2**63) if doc_id is None else doc_id

    texts = [(text or "").encode() for _, text in rows]
    oldest: dict[bytes, int] = {}
    for (doc_id, _), data in zip(rows, texts):
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            oldest[window] = min(age(doc_id), oldest.get(window, age(doc_id)))
    out = []
    for (doc_id, _), data in zip(rows, texts):
        mask, own = np.zeros(len(data), dtype=bool), set()
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if oldest[window] < age(doc_id) or window in own:
                mask[at : at + length] = True
            own.add(window)
        rest = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out.append((doc_id, len(data), int(mask.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found(df, length=100):
    return sorted(map(tuple, remove_repeats(df, length).collect()), key=repr)


def repeating(seed):
    rng = random.Random(seed)
    syllables = ["th", "ing", "é", "ver", "lich", "on", "and", "ß", "x" * 30]

    def text(n):
        return " ".join(rng.choice(syllables) + rng.choice(syllables) for _ in range(n))

    shared = [text(30) for _ in range(5)]
    out = []
    for doc_id in range(120):
        text_ = text(rng.randrange(60))
        kind = rng.random()
        if kind < 0.5:
            text_ += rng.choice(shared) + text(rng.randrange(30)) + rng.choice(shared)[: rng.randrange(200)]
        elif kind < 0.6 and out:
            text_ = out[-1][1]
        elif kind < 0.7:
            text_ = "a" * rng.randrange(400)
        elif kind < 0.8:
            text_ += text_
        out.append((doc_id, text_))
    return out


@pytest.mark.parametrize("bucket_rows", [60_000, 25])
def test_like_brute_force_over_one_and_many_buckets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket_rows)
    rows = repeating(bucket_rows)
    assert found(cases.documents(spark, rows)) == brute(rows)


def test_a_text_over_several_blocks(spark, monkeypatch):
    rng = random.Random(1)
    part = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, part + "!" + part[500:2500] + "?" * 300), (2, "#" + part[100:2900])]
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    parts = suffix_dedup.segments(*_buffers([text for _, text in rows]), 100)
    windows = int((parts["hi"] - parts["lo"] + 1).sum())
    assert windows == sum(len(text) - 99 for _, text in rows)
    assert found(cases.documents(spark, rows)) == brute(rows)


def _buffers(texts):
    data = [t.encode() for t in texts]
    return (
        np.frombuffer(b"".join(data), dtype=np.uint8),
        np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64),
    )


def test_awkward_rows(spark):
    texts = [item for item in cases.awkward_texts() if len(item[1] or "") < 5000]
    assert found(cases.documents(spark, texts)) == brute(texts)


def test_kept_text_is_what_the_digest_is_of(spark):
    rows = [(1, "abc " * 50), (2, "abc " * 50 + "tail")]
    for row in remove_repeats(cases.documents(spark, rows), texts=True).collect():
        assert hashlib.sha256(row.kept_text.encode()).hexdigest() == row.kept_sha256


def test_empty_table(spark):
    assert remove_repeats(cases.empty(spark)).collect() == []


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(0)
    keys = rng.integers(97, 99, (500, 19)).astype(np.uint8)
    ordered = [keys[i].tobytes() for i in multikey_order(keys)]
    assert ordered == sorted(ordered)
