"""Array code run inside Arrow tasks: UTF-8 buffers to word hashes and shingle sets.

All of it is vectorised over the bytes of many texts at once, so that a task spends nanoseconds, not
microseconds, on a word. Texts are handled in ranges of at most ``RANGE_BYTES`` bytes; a longer text is cut
at white space, and its words are put together again, so memory does not follow the longest text's bytes
times the width of the intermediate arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RANGE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[0x41:0x5B] += np.uint64(0x20)
LOWER += np.uint64(1)

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_A
    h ^= h >> np.uint64(27)
    h *= _MIX_B
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 1 << 16)
        table = np.full(size, _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
        table = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        table[0] = 1
        _inverse_powers = np.multiply.accumulate(table)
    return _powers[:n], _inverse_powers[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data if data is not None else b"", dtype=np.uint8), offsets


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        after = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        after = min(max(after, first + 1), rows)
        yield first, after
        first = after


def _ranges(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    for first, after in row_groups(offsets, RANGE_BYTES):
        start, end = int(offsets[first]), int(offsets[after])
        while end - start > RANGE_BYTES:
            spaces = np.flatnonzero(SPACE[data[start : start + RANGE_BYTES]])
            if not len(spaces):
                break
            cut = start + int(spaces[-1]) + 1
            yield first, after, start, cut
            start = cut
        if end > start:
            yield first, after, start, end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the row it stands in, in text order."""
    hashes, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for first, after, start, end in _ranges(data, offsets):
        text = data[start:end]
        inside = ~SPACE[text]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = np.clip(offsets[first : after + 1] - start, 0, end - start)
        at = borders[borders < end - start]
        begins[at] = inside[at]
        at = borders[borders > 0] - 1
        ends[at] = inside[at]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = powers(len(text))
        sums = np.empty(len(text) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(LOWER[text] * power, out=sums[1:])
        found = (sums[ends] - sums[begins]) * inverse[begins]
        hashes.append(mix(found + (ends - begins).astype(np.uint64)))
        rows.append(np.searchsorted(borders, begins, side="right") - 1 + first)
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, end to end, and the offsets of the rows.

    A row with fewer words than a shingle has one shingle, its whole sequence; without words it has none.
    """
    hashes, rows = word_hashes(data, offsets)
    count = len(offsets) - 1
    ends = np.cumsum(np.bincount(rows, minlength=count)) if count else np.zeros(0, dtype=np.int64)
    joined = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for i in range(words):
        joined = mix(joined * _STEP + hashes[i : i + len(joined)])
    sets, sizes, begin = [np.zeros(0, dtype=np.uint64)], np.zeros(count, dtype=np.int64), 0
    for row, end in enumerate(ends.tolist()):
        if end - begin >= words:
            found = np.unique(joined[begin : end - words + 1])
        else:
            found = np.full(int(end > begin), end - begin, dtype=np.uint64)
            for i in range(begin, end):
                found = mix(found * _STEP + hashes[i : i + 1])
        sizes[row] = len(found)
        sets.append(found)
        begin = end
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def set_digests(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, independent of order."""
    digests = []
    for salt in (_MIX_A, _MIX_B):
        sums = np.zeros(len(sets) + 1, dtype=np.uint64)
        np.cumsum(mix(sets ^ salt), out=sums[1:])
        digests.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]))
    return digests[0].view(np.int64), digests[1].view(np.int64)
