"""Token counts by batch encoding in Arrow tasks that return lengths only.

Texts are encoded in batches of at most ``BATCH_BYTES`` bytes, so a task's memory follows neither the number of rows in
an Arrow batch nor the longest text. Texts over ``PIECE_BYTES`` are first split before single spaces between two ASCII
letters: there byte-level pre-tokenisers always begin a new word, and no added token has a part of both sides, so the
counts of the pieces add up to that of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.hashing import row_groups, utf8
from thermaline.llm.tasks import in_arrow

BATCH_BYTES = 1 << 18
PIECE_BYTES = 1 << 16
_SAFE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=4)
def _encoder(path: str):
    """A function from texts to token counts, and whether texts may be split."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]), False
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (
        lambda texts: [len(found) for found in model.encode_batch_fast(texts, add_special_tokens=False)]
    ), True


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """``text`` cut at safe boundaries after at least ``limit`` bytes each; whole if it has none."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def count_tokens(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """The number of tokens of each text."""
    encode, splits = _encoder(path)
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    for first, after in row_groups(offsets, BATCH_BYTES):
        texts, rows, size = [], [], 0
        for row in range(first, after):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            for piece in pieces(text) if splits else (text,):
                if size and size + len(piece) > BATCH_BYTES:
                    np.add.at(counts, rows, encode(texts))
                    texts, rows, size = [], [], 0
                texts.append(piece.decode("utf-8", errors="replace"))
                rows.append(row)
                size += len(piece)
        if texts:
            np.add.at(counts, rows, encode(texts))
    return counts


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Documents (doc_id, text, ...) to (doc_id, n_bytes, n_tokens, over_limit).

    ``vocabulary`` is the path, on every executor, of a .json file of the tokenizers library or a .model file of
    sentencepiece. No begin, end or other special token is added; strings of special tokens inside a text are taken as
    the library takes them by default. A null text is an empty one with no tokens. Rows are counted each for itself;
    a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            counts = count_tokens(data, offsets, vocabulary)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
