from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from llm import cases

from thermaline.llm.token_counts import pieces, token_counts

SPECIAL = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "don't  stop\n\n now " * 9000, "x" * 70_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_like_the_library_on_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [*cases.awkward_texts(), *[(900 + i, t) for i, t in enumerate(SPECIAL)]]
    if name.startswith("word"):
        texts = [t for t in texts if len(t[1] or "") < 30_000]
    model = tokenizers.Tokenizer.from_file(path)
    want = []
    for doc_id, text in texts:
        n = len(model.encode(text or "", add_special_tokens=False))
        want.append((doc_id, len((text or "").encode()), n, n > 300))
    got = token_counts(cases.documents(spark, texts), path, limit=300).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_model_file(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in cases.awkward_texts() if len(t[1] or "") < 5000]
    got = token_counts(cases.documents(spark, texts), path).collect()
    want = [(doc_id, len(model.encode(text or ""))) for doc_id, text in texts]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)


def test_pieces_make_up_the_text_and_begin_at_words():
    text = b"one two, three  four 5 six seven eight nine" * 3
    cut = list(pieces(text, 4))
    assert b"".join(cut) == text and len(cut) > 5
    assert all(piece[:1] == b" " and piece[1:2].isalpha() for piece in cut[1:])
    assert list(pieces(b"x" * 50, 4)) == [b"x" * 50]


def test_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts(cases.empty(spark), path).collect() == []
