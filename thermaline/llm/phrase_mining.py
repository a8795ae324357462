"""Phrases whose words keep together, by dynamic itemset counting over shards.

The corpus is written once as a fixed number of shards, which are scanned in a cycle. Single words are counted from the
first shard on. After each shard, phrases become active whose two subphrases (all but the last word, all but the first)
have both reached the threshold so far; they are counted from the next shard on, until every shard was scanned once for
them. So lengths are counted side by side, a phrase that can't be frequent is never counted, and each frequent one has
its exact total after one full cycle of its own.

What tasks must know is when a subphrase reached the threshold. That is kept in a table of fixed size: a byte for each
hash slot, the step at which the first phrase of the slot got there. Phrases that share a slot are only activated
earlier than they need be, in each scan alike, and still for one full cycle; so none is missed. Which keys are frequent is
kept for the last scan in a finer table of bits, of fixed size as well.

Scans count keys of 40 bits, as most phrases occur once or twice and needn't be spelled out. Keys travel as sorted runs of a
few hundred, in buckets of leading bits: a row for each run, not for each key, with the gaps between its keys and their
counts in as few bytes each as the run's largest one takes. A task merges the runs of one bucket after the other, so it
holds one bucket's distinct keys. A last scan spells the frequent phrases and counts them by their text, so phrases that
share a key do no harm. Their texts travel sorted and compressed, a row for each bucket of a task, and are merged likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from thermaline.llm.hashing import mix, powers, row_groups, utf8
from thermaline.llm.tasks import in_arrow
from thermaline.staging import discard, stage, staging_path, staging_scope

SHARDS = 3
#: Slots of the table of steps, for each length; its size doesn't grow with the corpus.
SLOTS = 1 << 21
#: Bits of the table of frequent keys for each length: 8 MB, of which each step sends the driver the words that are not zero.
FINE = 1 << 26
NEVER = 255
GROUP_BYTES = 2 << 20
#: Bits of a key. Phrases that share one are activated or spelled needlessly; slots are taken from the last ones.
KEY_BITS = 40
#: Keys in a run, keys held before they are merged, and bytes of text for each bucket of keys, of which there are up to 65,536.
RUN = 512
HELD = 4 << 20
BUCKET_BYTES = 8 << 20
#: Spelled phrases held before they are merged; their buckets are fewer by as many bits, so that a row holds many of them.
HELD_TEXTS = 2 << 20
FEWER_BITS = 3

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUNS = "length int, since int, bucket int, size int, first long, gaps binary, counts binary"
_TEXTS = "lang string, length int, bucket int, size int, phrases binary, counts binary"
_MARKS = "length int, at int, bits long"
_COUNTS = "lang string, length int, phrase string, n long"
_KEY = np.uint64((1 << KEY_BITS) - 1)
_FULL = np.left_shift(np.int64(1), 8 * np.arange(1, 8))


def _ranges(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after, begin, end) of ranges of bounded bytes; a longer text is cut at the ends of pieces."""
    for first, after in row_groups(offsets, GROUP_BYTES):
        begin, end = int(offsets[first]), int(offsets[after])
        while end - begin > GROUP_BYTES:
            cuts = np.flatnonzero(_CLASS[data[begin : begin + GROUP_BYTES]] == _BREAK)
            if len(cuts):
                cut = begin + int(cuts[-1]) + 1
            else:
                behind = np.flatnonzero(_CLASS[data[begin + GROUP_BYTES : end]] == _BREAK)
                cut = begin + GROUP_BYTES + int(behind[0]) + 1 if len(behind) else end
            yield first, after, begin, cut
            begin = cut
        if end > begin:
            yield first, after, begin, end


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(words, piece numbers, rows) of the ranges of many texts: A-Z lower-cased, in text order."""
    for first, after, start, end in _ranges(data, offsets):
        text = _LOWER[data[start:end]]
        kind = _CLASS[text]
        inside = kind == _WORD
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = np.clip(offsets[first : after + 1] - start, 0, end - start)
        at = borders[borders < end - start]
        begins[at] = inside[at]
        at = borders[borders > 0] - 1
        ends[at] = inside[at]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(begins):
            continue
        rows = np.searchsorted(borders, begins, side="right") - 1
        piece = np.cumsum(kind == _BREAK)[begins] + rows
        stops = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(stops), pa.py_buffer(text[inside].tobytes())]
        )
        yield words, piece, rows + first


def _word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    sizes = np.diff(offsets).astype(np.uint64)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + sizes)


def _phrase_keys(keys: np.ndarray, langs: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of the phrases of ``length`` words that begin at each word."""
    count = max(0, len(keys) - length + 1)
    found = langs[:count] + np.uint64(length)
    for i in range(length):
        found = mix(found * _STEP + keys[i : i + count])
    return found


class Range:
    """The phrases of one range of texts."""

    def __init__(self, words: pa.Array, piece: np.ndarray, rows: np.ndarray, langs: np.ndarray, lang_keys: np.ndarray):
        encoded = words.dictionary_encode()
        self.dictionary, self.places = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.words, self.lang = _word_keys(self.dictionary)[self.places], langs[rows]
        self.lang_keys, self.piece, self.rows = lang_keys[self.lang], piece, rows

    def keys(self, length: int) -> np.ndarray:
        return _phrase_keys(self.words, self.lang_keys, length)

    def whole(self, length: int) -> np.ndarray:
        """Whether the words from each one on are in one piece."""
        count = max(0, len(self.places) - length + 1)
        return (self.piece[:count] == self.piece[length - 1 :]) & (self.rows[:count] == self.rows[length - 1 :])

    def spelled(self, at: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(a place, the text, the count) of each of the distinct phrases that begin at ``at``."""
        group, width = np.unique(self.lang[at], return_inverse=True)[1], len(self.dictionary)
        for i in range(length):
            if i > 1:
                group = np.unique(group, return_inverse=True)[1]
            group = group * width + self.places[at + i]
        _, head, n = np.unique(group, return_index=True, return_counts=True)
        head = at[head]
        phrase = self.dictionary.take(pa.array(self.places[head]))
        for i in range(1, length):
            following = self.dictionary.take(pa.array(self.places[head + i]))
            phrase = pc.binary_join_element_wise(phrase, following, pa.scalar(b" ", pa.large_binary()))
        return head, phrase, n


def _text_ranges(batch: pa.RecordBatch) -> tuple[list[str], Iterator[Range]]:
    """The languages of a batch of (lang, text), and its ranges."""
    names = batch.column(0).to_pylist()
    order = sorted(set(names))
    code = {name: i for i, name in enumerate(order)}
    langs = np.array([code[name] for name in names], dtype=np.int64)
    lang_keys = _word_keys(pa.array([name.encode() for name in order], pa.large_binary()))
    data, offsets = utf8(batch.column(1))
    return order, (Range(*found, langs, lang_keys) for found in pieces(data, offsets))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts (one each without ``counts``)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts, heads)
    return keys[heads], sums.astype(np.int64)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A blob for the values (not negative) from each cut on, each in the bytes that the blob's largest one takes."""
    sizes = np.diff(np.append(cuts, len(values)))
    widths = np.searchsorted(_FULL, np.maximum.reduceat(values, cuts), side="right") + 1
    widest = int(widths.max(initial=1))
    kept = np.arange(widest) < np.repeat(widths, sizes)[:, None]
    offsets = np.concatenate([[0], np.cumsum(widths * sizes)]).astype(np.int32)
    data = values.view(np.uint8).reshape(-1, 8)[:, :widest][kept]
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(blobs: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The values of a column of blobs that hold ``sizes`` values each."""
    blobs = blobs.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], dtype=np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    widths = np.diff(offsets) // sizes
    widest = int(widths.max(initial=1))
    values = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
    values[:, :widest][np.arange(widest) < np.repeat(widths, sizes)[:, None]] = data
    return values.view(np.int64).reshape(-1)


def _runs(length: int, since: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of at most ``RUN`` keys of one bucket; ``keys`` are distinct and in order."""
    keys = keys.view(np.int64)
    bucket = keys >> (KEY_BITS - bits)
    borders = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    cuts = np.union1d(np.arange(0, len(keys), RUN), borders).astype(np.int64)
    gaps = np.diff(keys, prepend=0)
    gaps[cuts] = 0
    numbers = [np.full(len(cuts), length), np.full(len(cuts), since), bucket[cuts], np.diff(np.append(cuts, len(keys)))]
    columns = [*(pa.array(column.astype(np.int32)) for column in numbers), pa.array(keys[cuts])]
    columns += [_packed(gaps, cuts), _packed(counts, cuts)]
    return pa.RecordBatch.from_arrays(columns, names=["length", "since", "bucket", "size", "first", "gaps", "counts"])


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of the runs of a batch, and where each row's begin."""
    sizes, first = (batch.column(name).to_numpy().astype(np.int64) for name in ("size", "first"))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keys = np.cumsum(_unpacked(batch.column("gaps"), sizes))
    keys += np.repeat(first - keys[offsets[:-1]], sizes)
    return keys.view(np.uint64), _unpacked(batch.column("counts"), sizes), offsets


def shard_counts(
    shard: DataFrame, step: int, shards: int, longest: int, reached: list[np.ndarray], bits: int
) -> DataFrame:
    """Runs (length, since, bucket, keys, counts) of the phrases active at ``step`` in one shard of (lang, text).

    ``reached`` holds, for each length, the steps at which hash slots reached the threshold. Single words are active
    from the start, longer phrases ``since`` the step at which both subphrases had got there, each for one cycle.
    """
    shared = shard.sparkSession.sparkContext.broadcast(reached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = shared.value
        slots = np.uint64(len(reached[0]))
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for part in _text_ranges(batch)[1]:
                steps = None
                for length in range(1, longest + 1):
                    keys, ok = part.keys(length), part.whole(length)
                    active = np.maximum(steps[:-1], steps[1:]) if length > 1 else np.full(len(keys), -1, dtype=np.int16)
                    at = np.flatnonzero(ok & (active < step) & (step <= active + shards))
                    keyed, since = keys[at] & _KEY, active[at]
                    for first in (np.flatnonzero(np.bincount(since + 1)) - 1).tolist():
                        held.setdefault((length, first), []).append(keyed[since == first])
                    size += len(at)
                    steps = reached[length - 1][(keys % slots).astype(np.int64)].astype(np.int16)
                    if (steps == NEVER).all():
                        break
                if size >= HELD:
                    for group, arrays in held.items():
                        yield _runs(*group, *_summed(np.concatenate(arrays)), bits)
                    held, size = {}, 0
        for group, arrays in held.items():
            yield _runs(*group, *_summed(np.concatenate(arrays)), bits)

    return in_arrow(shard, run, _RUNS)


def merged_runs(runs: DataFrame, bits: int) -> DataFrame:
    """The same keys, each once in its (length, since), with the sums of their counts.

    Keys are hashes, so buckets are of one size, and a frequent key has one entry for each few million words. A task
    holds the distinct keys of one bucket and at most ``HELD`` or as many not yet merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, counts, merged, waiting = None, [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            borders = np.flatnonzero((labels[1:] != labels[:-1]).any(axis=1)) + 1
            of_keys, of_counts, offsets = _values(batch)
            for begin, end in zip([0, *borders.tolist()], [*borders.tolist(), len(labels)]):
                if group != (found := tuple(labels[begin].tolist())):
                    if group:
                        yield _runs(*group[:2], *_summed(np.concatenate(keys), np.concatenate(counts)), bits)
                    group, keys, counts, merged, waiting = found, [], [], 0, 0
                part = slice(int(offsets[begin]), int(offsets[end]))
                keys.append(of_keys[part])
                counts.append(of_counts[part])
                waiting += part.stop - part.start
                if waiting >= max(HELD, merged):
                    both = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, merged, waiting = [both[0]], [both[1]], len(both[0]), 0
        if group:
            yield _runs(*group[:2], *_summed(np.concatenate(keys), np.concatenate(counts)), bits)

    order = ["length", "since", "bucket"]
    return in_arrow(runs.repartition(*order).sortWithinPartitions(*order), run, _RUNS)


def _texts(names: list[str], length: int, lang: np.ndarray, bucket: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """A row for each language and bucket: its distinct phrases in order, one a line, and the sums of their counts."""
    encoded = phrase.dictionary_encode()
    rank = np.empty(len(encoded.dictionary), dtype=np.int64)
    rank[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(len(rank))
    place = rank[encoded.indices.to_numpy()]
    group = lang.astype(np.int64) * (int(bucket.max(initial=0)) + 1) + bucket
    order = np.argsort(group * len(rank) + place)
    group, place = group[order], place[order]
    new = np.ones((2, len(order)), dtype=bool)
    new[0, 1:] = group[1:] != group[:-1]
    new[1, 1:] = new[0, 1:] | (place[1:] != place[:-1])
    heads = np.flatnonzero(new[1])
    cuts = np.flatnonzero(new[0][heads])
    lines = pc.binary_join_element_wise(phrase.take(pa.array(order[heads])), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    borders = [*offsets[cuts].tolist(), int(offsets[-1])]
    blobs = [pa.compress(lines.buffers()[2].slice(x, y - x), codec="zstd", asbytes=True) for x, y in zip(borders, borders[1:])]
    at = order[heads[cuts]]
    columns = [pa.array([names[code] for code in lang[at].tolist()], pa.string())]
    columns += [pa.array(c.astype(np.int32)) for c in (np.full(len(cuts), length), bucket[at], np.diff(borders))]
    columns += [pa.array(blobs, pa.binary()), _packed(np.add.reduceat(n[order], heads), cuts)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "length", "bucket", "size", "phrases", "counts"])


def _lines(text: bytes) -> pa.Array:
    """The lines of a text, without their ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    stops = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
    buffers = [None, pa.py_buffer(stops), pa.py_buffer(data[data != 0x0A])]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), buffers)


def spelled_texts(corpus: DataFrame, longest: int, frequent: np.ndarray, bits: int) -> DataFrame:
    """Rows (lang, length, bucket, size, phrases, counts) of all phrases whose bit in ``frequent`` is set.

    Length 0 counts all words. ``frequent`` has a row of 64-bit words for each length.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        slots = np.uint64(64 * frequent.shape[1])
        codes: dict[str, int] = {}
        total: dict[str, int] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]] = {}
        size = 0

        def joined() -> Iterator[pa.RecordBatch]:
            for length, found in held.items():
                lang, bucket, phrase, n = zip(*found)
                yield _texts(list(codes), length, *map(np.concatenate, (lang, bucket)), pa.concat_arrays(phrase), np.concatenate(n))

        for batch in batches:
            names, parts = _text_ranges(batch)
            code = np.array([codes.setdefault(name, len(codes)) for name in names], dtype=np.int32)
            for part in parts:
                for name, n in zip(names, np.bincount(part.lang, minlength=len(names)).tolist()):
                    total[name] = total.get(name, 0) + n
                for length in range(1, longest + 1):
                    keys = part.keys(length)
                    slot = (keys % slots).astype(np.int64)
                    bit = (frequent[length - 1][slot >> 6] >> (slot & 63)) & 1
                    at = np.flatnonzero((bit == 1) & part.whole(length))
                    if not len(at):
                        break
                    head, phrase, n = part.spelled(at, length)
                    bucket = ((keys[head] & _KEY) >> np.uint64(KEY_BITS - bits)).astype(np.int32)
                    held.setdefault(length, []).append((code[part.lang[head]], bucket, phrase, n))
                    size += len(head)
                if size >= HELD_TEXTS:
                    yield from joined()
                    held, size = {}, 0
        yield from joined()
        if total := {name: n for name, n in total.items() if n}:
            lang = np.array([codes[name] for name in total], dtype=np.int32)
            words = pa.array([b""] * len(total), pa.large_binary())
            yield _texts(list(codes), 0, lang, np.zeros(len(total), dtype=np.int32), words, np.array(list(total.values())))

    return in_arrow(corpus, run, _TEXTS)


def spelled_counts(corpus: DataFrame, longest: int, frequent: np.ndarray, bits: int) -> DataFrame:
    """(lang, length, phrase, n) of all phrases whose bit in ``frequent`` is set; length 0 counts all words.

    A task merges one (lang, length, bucket) after the other and holds its distinct phrases.
    """

    def summed(texts: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        encoded = pa.concat_arrays(texts).dictionary_encode()
        sums = np.zeros(len(encoded.dictionary), dtype=np.int64)
        np.add.at(sums, encoded.indices.to_numpy(), np.concatenate(counts))
        return encoded.dictionary, sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, texts, counts, merged, waiting = None, [], [], 0, 0
        for batch in batches:
            for lang, length, bucket, size, blob, packed in zip(*(column.to_pylist() for column in batch.columns)):
                if group != (found := (lang, length, bucket)):
                    if group:
                        yield _counted(*group[:2], *summed(texts, counts))
                    group, texts, counts, merged, waiting = found, [], [], 0, 0
                texts.append(_lines(pa.decompress(blob, size, codec="zstd")))
                counts.append(_unpacked(pa.array([packed], pa.binary()), np.array([len(texts[-1])])))
                waiting += len(texts[-1])
                if waiting >= max(HELD_TEXTS, merged):
                    both = summed(texts, counts)
                    texts, counts, merged, waiting = [both[0]], [both[1]], len(both[0]), 0
        if group:
            yield _counted(*group[:2], *summed(texts, counts))

    order = ["lang", "length", "bucket"]
    texts = spelled_texts(corpus, longest, frequent, bits)
    return in_arrow(texts.repartition(*order).sortWithinPartitions(*order), run, _COUNTS)


def _counted(lang: str, length: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    text = pc.cast(phrase, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
    columns = [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), length, dtype=np.int32)), text, pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "length", "phrase", "n"])


def reached_bits(runs: DataFrame, least: int, longest: int, slots: int) -> np.ndarray:
    """A bit for each length and slot: whether the slot has a key with ``least`` occurrences in merged ``runs``.

    Bits are joined by a bitwise or in words of 64, so the driver reads at most ``slots / 64`` rows a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, offsets = _values(batch)
            enough = counts >= least
            length = np.repeat(batch.column("length").to_numpy(), np.diff(offsets))[enough]
            slot = (keys[enough] % np.uint64(slots)).astype(np.int64)
            columns = [length, (slot >> 6).astype(np.int32), np.left_shift(np.int64(1), slot & 63)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["length", "at", "bits"])

    marks = in_arrow(runs.select("length", "size", "first", "gaps", "counts"), run, _MARKS)
    merged = marks.groupBy("length", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    length, at, bits = (column.to_numpy() for column in merged.columns)
    found = np.zeros((longest, slots // 64), dtype=np.int64)
    found[length - 1, at] = bits
    return found


def folded(bits: np.ndarray, slots: int) -> np.ndarray:
    """Whether any of the bits that are equal modulo ``slots`` is set; both sizes are powers of two."""
    words = np.bitwise_or.reduce(bits.reshape(-1, slots // 64), axis=0)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def phrase_counts(docs: DataFrame, longest: int, least: int, shards: int = SHARDS, slots: int = SLOTS, fine: int = FINE) -> DataFrame:
    """(lang, length, phrase, n): exact totals of all phrases with ``least`` occurrences, and some others.

    ``docs`` has (lang, text) without nulls; length 0 stands for all words of a language. One job scans one shard and
    writes the running totals of phrases still counted, so a lost executor repeats a part of one scan. There are at most ``longest`` cycles and
    the last scan. ``slots`` and ``fine``, at least as many, are powers of two from 64 on.
    """
    spark = docs.sparkSession
    path = staging_path(spark, "shards")
    sharded = docs.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    written_text = Observation()
    sharded.observe(written_text, F.sum(F.octet_length("text")).alias("bytes")).write.partitionBy("shard").parquet(path)
    bits = min(16, max(4, ((written_text.get["bytes"] or 0) // BUCKET_BYTES).bit_length()))
    corpus = spark.read.schema("lang string, text string, shard int").parquet(path)
    reached = [np.full(slots, NEVER, dtype=np.uint8) for _ in range(longest)]
    frequent = np.zeros((longest, fine // 64), dtype=np.int64)
    ends = [shards - 1] + [-1] * (longest - 1)
    totals, written, step = spark.createDataFrame([], _RUNS), None, 0
    while step <= max(ends):
        shard = corpus.where(F.col("shard") == step % shards).select("lang", "text")
        scanned = shard_counts(shard, step, shards, longest, reached, bits)
        before, written = written, staging_path(spark, "phrases")
        # A phrase that has completed its cycle is known as frequent or not; its total is carried on no longer.
        totals = totals.where(F.col("since") + shards >= step)
        totals = merged_runs(totals.unionByName(scanned), bits)
        totals.write.parquet(written)
        totals = spark.read.schema(totals.schema).parquet(written)
        if before:
            discard(spark, before)
        now = reached_bits(totals, least, longest, fine)
        frequent |= now
        for length in range(1, longest + 1):
            if step <= ends[length - 1]:
                new = folded(now[length - 1], slots) & (reached[length - 1] == NEVER)
                if new.any():
                    reached[length - 1] = np.where(new, np.uint8(step), reached[length - 1])
                    if length < longest:
                        ends[length] = step + shards
        step += 1
    discard(spark, written)
    spelled = spelled_counts(corpus.select("lang", "text"), longest, frequent, max(4, bits - FEWER_BITS))
    return stage(spelled, "spelled")


def scored_phrases(counts: DataFrame, longest: int, least: int) -> DataFrame:
    """Candidates with their lowest-scoring cut: (lang, phrase, length, a, l, r, score).

    A cut after the first k words has the score floor(1000000 * a * a / (l * r)); of equal scores the smallest k counts.
    Parts are found by joins with the frequent phrases, whose written table has a true size.
    """
    frequent = counts.where((F.col("length") > 0) & (F.col("n") >= least))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    words = F.split("phrase", " ")
    cuts = frequent.where("length >= 2").select(
        "lang",
        "phrase",
        "length",
        F.col("n").alias("a"),
        words.alias("words"),
        F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"),
    )
    cuts = cuts.select(
        "lang",
        "phrase",
        "length",
        "a",
        "k",
        F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("head"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.col("length"))).alias("tail"),
    )
    wide = "decimal(38,0)"
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .withColumn(
            "score",
            F.expr(
                f"cast(cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as {wide})"
                f" div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as {wide}) as long)"
            ),
        )
    )
    return (
        scored.groupBy("lang", "phrase", "length", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.score")
    )


def without_contained(candidates: DataFrame, longest: int) -> DataFrame:
    """Candidates but those inside a longer one (dropped or not) that has at least half of their occurrences."""
    inner = None
    for shorter in range(2, longest):
        windows = f"transform(sequence(1, length - {shorter - 1}), i -> concat_ws(' ', slice(split(phrase, ' '), i, {shorter})))"
        part = candidates.where(F.col("length") > shorter).select(
            "lang", F.col("a").alias("outer"), F.explode(F.expr(windows)).alias("phrase")
        )
        inner = part if inner is None else inner.unionByName(part)
    if inner is None:
        return candidates
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    covered = F.coalesce(100 * F.col("outer") >= 50 * F.col("a"), F.lit(False))
    return candidates.join(inner, ["lang", "phrase"], "left").where(~covered).drop("outer")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language whose words keep together: (lang, rank, phrase, a, l, r, n, score).

    ``docs`` has (lang, text); other columns are ignored. A-Z are lower-cased; texts are split at ``.,;:!?`` and the ends
    of lines into pieces, pieces at blanks and tabs into words. a is the number of occurrences of the phrase, l and r
    those of the two parts of its lowest-scoring cut, n that of all words of the language. Candidates have 2 to
    ``longest`` words and at least ``least`` occurrences; those that stand inside a longer candidate with half of their
    occurrences are dropped. Ranks run from 1, by score and a (largest first), then by the phrase's bytes.

    A null language is ``und``; a null text is empty. Repeated rows and ids all count. Empty tables and languages
    without candidates give no rows. A text of any length is cut into ranges only where pieces end.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with staging_scope(docs.sparkSession):
        counts = phrase_counts(docs, longest, least)
        sizes = counts.where("length = 0").select("lang", "n")
        candidates = stage(scored_phrases(counts, longest, least), "candidates")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = without_contained(candidates, longest).withColumn("rank", F.row_number().over(order))
        found = (
            ranked.where(F.col("rank") <= top)
            .join(sizes, "lang")
            .select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        )
        return stage(found, "collocations", outer=True)
