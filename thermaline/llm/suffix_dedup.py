"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

Only suffixes at anchors are sorted. Among the 24-byte strings of a window of ``length`` bytes, the anchor is
the leftmost one of least hash, so equal windows have equal anchors at equal distance, and consecutive windows
share theirs: a stretch of text splits into segments, each with one anchor and all windows it stands for.

1. Anchors that occur once are dropped, by an aggregate that is combined before it is shuffled. Of the rest, segments
   are compared whole by 128-bit digests: in every document but the first that holds a segment, all of it is repeated.
2. Anchors that occur in different segments (the ends of repeats) are left open. Their suffixes, with the bytes
   to their left, are range-partitioned by their leading bytes with sampled splitters. Each bucket sorts its
   suffixes by multikey quicksort, eight bytes a step, and common prefix lengths tell which windows are equal.
3. Windows that a bucket's neighbours may hold too, those that begin like its first or last suffix, are compared
   across the boundaries: the first window of each class, and only where another bucket has the same bytes around
   the anchor.

A splitter may fall inside one anchor's suffixes, so a hot anchor is spread over as many buckets as its size
asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.hashing import mix, powers, row_groups, utf8
from thermaline.llm.tasks import in_arrow
from thermaline.staging import stage

LENGTH = 100
ANCHOR = 24
BLOCK_BYTES = 1 << 20
BUCKET_ROWS = 60_000
CELL = 8
NO_ID = -(2**63)

_PLACE = np.uint64((1 << 24) - 1)
_OTHER = np.uint64(0xFF51AFD7ED558CCD)


def _sums(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * power, out=out[1:])
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, covered = values, 1
    while covered * 2 <= width:
        out = np.minimum(out[:-covered], out[covered:])
        covered *= 2
    if covered < width:
        rest = width - covered
        out = np.minimum(out[:-rest], out[rest:])
    return out


def _blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    for first, after in row_groups(offsets, BLOCK_BYTES):
        start, end = int(offsets[first]), int(offsets[after])
        while end - start > 2 * BLOCK_BYTES:
            yield first, after, start, start + BLOCK_BYTES + length - 1
            start += BLOCK_BYTES
        yield first, after, start, end


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The segments of each row: row, first and last window start, anchor, digest of anchor and segment.

    Positions are bytes of ``data``. A row of several blocks is cut between windows, which only opens the
    segment at the cut.
    """
    width = length - ANCHOR + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for first, after, start, end in _blocks(offsets, length):
        size = end - start
        if size < length:
            continue
        text = data[start:end].astype(np.uint64) + np.uint64(1)
        power, inverse = powers(size)
        sums = _sums(text, power)
        grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: size - ANCHOR + 1])
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(keyed, width) & _PLACE).astype(np.int64)
        borders = np.clip(offsets[first : after + 1] - start, 0, size)
        inside = np.ones(len(anchor) + 1, dtype=bool)
        inside[-1] = False
        for border in borders[1:-1].tolist():
            inside[max(0, border - length + 1) : min(border, len(anchor))] = False
        change = np.empty(len(anchor), dtype=bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-2]
        lo = np.flatnonzero(change & inside[:-1])
        stop = np.empty(len(anchor), dtype=bool)
        stop[-1] = True
        stop[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:-1]
        hi = np.flatnonzero(stop & inside[:-1])
        at = anchor[lo]
        other = _sums(mix(text), power)
        whole = (other[hi + length] - other[lo]) * inverse[lo]
        shape = ((at - lo) * 1024 + (hi - lo)).astype(np.uint64)
        whole = mix(whole ^ mix(shape + _OTHER)) >> np.uint64(1)
        row = np.searchsorted(borders, lo, side="right") - 1 + first
        parts.append((row, lo + start, hi + start, at + start, grams[at].view(np.int64), whole.view(np.int64)))
    names = ("row", "lo", "hi", "at", "anchor", "segment")
    if not parts:
        return {name: np.zeros(0, dtype=np.int64) for name in names}
    return {name: np.concatenate(column) for name, column in zip(names, zip(*parts))}


def _repeats(row: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Marks the segments that stand earlier in the same row."""
    order = np.lexsort((segment, row))
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (row[order[1:]] == row[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
    out = np.zeros(len(row), dtype=bool)
    out[order] = same
    return out


def anchor_kinds(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, is_open): the anchors that occur more than once, and whether in different segments.

    An Arrow batch is combined to a row per anchor before it leaves its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(*utf8(batch.column(0)), length)
            order = np.lexsort((found["segment"], found["anchor"]))
            anchor, segment = found["anchor"][order], found["segment"][order]
            first = np.ones(len(anchor), dtype=bool)
            first[1:] = anchor[1:] != anchor[:-1]
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(anchor))[: len(begin)] - 1
            columns = (anchor[begin], segment[begin], segment[end], end - begin + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "low", "high", "n"])

    parts = in_arrow(docs.select("text"), run, "anchor long, low long, high long, n long")
    return (
        parts.groupBy("anchor")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        .where("n > 1")
        .select("anchor", (F.col("low") < F.col("high")).alias("is_open"))
    )


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, segment, id): the distinct segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = segments(*utf8(batch.column(1)), length)
            ids = batch.column(0).to_numpy()
            fresh = ~_repeats(found["row"], found["segment"])
            columns = (found["anchor"][fresh], found["segment"][fresh], ids[found["row"][fresh]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "segment", "id"])

    return in_arrow(docs.select("id", "text"), run, "anchor long, segment long, id long")


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """The lexicographic order of equally long byte rows.

    Rows are ordered by their first eight bytes; only runs that are still equal go on to the next eight.
    """
    rows, width = keys.shape
    padded = np.zeros((rows, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = keys
    tokens = padded.view(">u8").astype(np.uint64)
    order = np.argsort(tokens[:, 0], kind="stable")
    run = np.zeros(rows, dtype=np.int64)
    for step in range(tokens.shape[1]):
        column = tokens[order, step]
        new = np.ones(rows, dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (column[1:] != column[:-1])
        run = np.cumsum(new)
        if step + 1 == tokens.shape[1]:
            break
        equal = ~new
        equal[:-1] |= ~new[1:]
        open_at = np.flatnonzero(equal)
        if not len(open_at):
            break
        among = order[open_at]
        order[open_at] = among[np.lexsort((tokens[among, step + 1], run[open_at]))]
    return order


def _common(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    step = 1 << 16
    for begin in range(1, len(order), step):
        here = order[begin : begin + step]
        differ = keys[here] != keys[order[begin - 1 : begin - 1 + len(here)]]
        out[begin : begin + len(here)] = np.where(
            differ.any(axis=1), differ.argmax(axis=1), keys.shape[1]
        )
    return out


_LONGS = pa.list_(pa.int64())
_FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("digest", pa.int64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("cell_a", pa.int64()),
        ("cell_b", pa.int64()),
        ("starts", _LONGS),
        ("window_a", _LONGS),
        ("window_b", _LONGS),
    ]
)
_FOUND_DDL = (
    "id long, digest long, start long, stop long, cell_a long, cell_b long, "
    "starts array<long>, window_a array<long>, window_b array<long>"
)


class _Lines:
    """Digests of the bytes around the anchors of some rows of a bucket."""

    def __init__(self, members: np.ndarray, left: np.ndarray, right: np.ndarray):
        lines = np.concatenate([left[members, ::-1], right[members]], axis=1).astype(np.uint64) + np.uint64(1)
        self.width, self.place = left.shape[1], np.zeros(len(left), dtype=np.int64)
        self.place[members] = np.arange(len(members))
        power, self.inverse = powers(lines.shape[1])
        self.sums = []
        for values in (lines, mix(lines ^ _OTHER)):
            total = np.zeros((len(members), lines.shape[1] + 1), dtype=np.uint64)
            np.cumsum(values * power[None, :], axis=1, out=total[:, 1:])
            self.sums.append(total)

    def digests(self, rows: np.ndarray, before: int, after: int, salt: int = 0) -> list[np.ndarray]:
        """Two digests of the bytes from ``before`` the anchor to ``after`` it."""
        at, begin = self.place[rows], self.width - before
        scale = self.inverse[begin]
        extra = np.uint64(salt)
        return [mix((s[at, self.width + after] - s[at, begin]) * scale + extra).view(np.int64) for s in self.sums]


def _padded(column: pa.Array, width: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), dtype=np.uint8)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if reverse:
        place = np.repeat(sizes, sizes) - 1 - place
    out[rows, place] = data[int(offsets[0]) : int(offsets[-1])]
    return out, sizes


def resolve_bucket(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The repeated windows of one bucket of open suffixes.

    Yields runs of windows that repeat an earlier one of this bucket (cell null) and, for windows that begin like the
    bucket's first or last suffix, the first of each class. The latter come in cells of ``CELL`` neighbouring windows
    of one row. A cell's digest covers the bytes that all its windows share, so windows can only be equal where the
    digests of their cells are.
    """
    width = length - ANCHOR
    columns = {name: table.column(name).to_numpy() for name in ("id", "digest", "at")}
    by_age = np.lexsort((columns["at"], columns["digest"], columns["id"]))
    table = table.take(pa.array(by_age)).combine_chunks()
    ids, digests, at = (columns[name][by_age] for name in ("id", "digest", "at"))
    right, right_sizes = _padded(table.column("suffix").combine_chunks(), length, False)
    left, left_sizes = _padded(table.column("before").combine_chunks(), width, True)
    n = len(ids)
    order, left_order = multikey_order(right), multikey_order(left)
    common, left_common = _common(right, order), _common(left, left_order)
    edge = np.zeros(n, dtype=bool)
    for end in (order[0], order[-1]):
        edge |= (right[:, :ANCHOR] == right[end, :ANCHOR]).all(axis=1)
    shared = np.zeros(n, dtype=bool)
    shared[order] = common >= ANCHOR
    shared[order[:-1]] |= common[1:] >= ANCHOR
    shared |= edge
    lines = _Lines(np.flatnonzero(edge), left, right)
    group, left_group = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    repeated: list[tuple[np.ndarray, np.ndarray]] = []
    cell: list[tuple[np.ndarray, ...]] = []
    for back in range(width + 1):
        rows = np.flatnonzero(shared & (right_sizes >= length - back) & (left_sizes >= back))
        if len(rows):
            group[order] = np.cumsum(common < length - back)
            left_group[left_order] = np.cumsum(left_common < back) if back else 0
            key = group[rows] * (n + 1) + left_group[rows]
            sort = np.argsort(key, kind="stable")
            rows, key = rows[sort], key[sort]
            first = np.ones(len(rows), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            head = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
            before = np.append(rows[:1], rows[:-1])
            later = ~first & (
                (ids[rows] > ids[head]) | ((ids[before] == ids[rows]) & (digests[before] == digests[rows]))
            )
            repeated.append((rows[later], at[rows[later]] - back))
            at_end = (group[rows] == group[order[0]]) | (group[rows] == group[order[-1]])
            reps = rows[first & at_end]
            cell.append((reps, at[reps] - back, *lines.digests(reps, back, length - back)))
        if cell and (back % CELL == CELL - 1 or back == width):
            yield from _cell_rows(cell, lines, back - back % CELL, back, length, ids, digests, at)
            cell = []
    if not repeated:
        return
    rows, starts = (np.concatenate(x) for x in zip(*repeated))
    order = np.lexsort((starts, digests[rows], ids[rows]))
    rows, starts = rows[order], starts[order]
    if not len(rows):
        return
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (
        (ids[rows[1:]] != ids[rows[:-1]])
        | (digests[rows[1:]] != digests[rows[:-1]])
        | (starts[1:] > starts[:-1] + 1)
    )
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(rows)) - 1
    none, lists = pa.nulls(len(begin), pa.int64()), pa.nulls(len(begin), _LONGS)
    known = (ids[rows[begin]], digests[rows[begin]], starts[begin], starts[stop])
    yield pa.RecordBatch.from_arrays(
        [*[pa.array(x) for x in known], none, none, lists, lists, lists], schema=_FOUND
    )


def _cell_rows(cell, lines, low: int, high: int, length: int, ids, digests, at) -> Iterator[pa.RecordBatch]:
    rows, *values = (np.concatenate(x) for x in zip(*cell))
    if not len(rows):
        return
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], [v[order] for v in values]
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    offsets = pa.array(np.append(begin, len(rows)), pa.int32())
    own = rows[begin]
    key = lines.digests(own, low, length - high, salt=low + 1)
    known = (ids[own], digests[own], at[own], at[own], *key)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]
    yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in known], *lists], schema=_FOUND)


_OPEN_DDL = "id long, digest long, at long, suffix binary, before binary"


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]), flat.to_numpy()


def _marked(found: dict[str, np.ndarray], ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which segments are among the marks of their row."""
    if not len(marks) or not len(found["row"]):
        return np.zeros(len(found["row"]), dtype=bool)
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    both = mix(marks.view(np.uint64) ^ mix(rows.astype(np.uint64)))
    wanted = mix(found["segment"].view(np.uint64) ^ mix(found["row"].astype(np.uint64)))
    return np.isin(wanted, both)


def open_suffixes(base: DataFrame, length: int) -> DataFrame:
    """The suffixes at the open anchors of each document, with the bytes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = segments(data, offsets, length)
            take = _marked(found, *_marks(batch.column(3))) & ~_repeats(found["row"], found["segment"])
            found = {name: column[take] for name, column in found.items()}
            rows = found["row"]
            for begin in range(0, len(rows), 20_000):
                part = slice(begin, begin + 20_000)
                lo, hi, at = found["lo"][part], found["hi"][part], found["at"][part]
                raw = data.tobytes() if len(rows) > 50 else data
                suffix = [bytes(raw[a:h]) for a, h in zip(at.tolist(), (hi + length).tolist())]
                before = [bytes(raw[s:a]) for s, a in zip(lo.tolist(), at.tolist())]
                of = pa.array(rows[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of),
                        batch.column(2).take(of),
                        pa.array(at - offsets[rows[part]]),
                        pa.array(suffix, pa.binary()),
                        pa.array(before, pa.binary()),
                    ],
                    names=["id", "digest", "at", "suffix", "before"],
                )

    return in_arrow(base.select("id", "text", "digest", "open"), run, _OPEN_DDL)


def _resolved(suffixes: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [batch for batch in batches if len(batch)]
        if kept:
            yield from resolve_bucket(pa.Table.from_batches(kept), length)

    return in_arrow(suffixes, run, _FOUND_DDL)


_REMOVED_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removal(base: DataFrame, length: int, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = segments(data, offsets, length)
            whole = _marked(found, *_marks(batch.column(3))) | _repeats(found["row"], found["segment"])
            starts, stops = [found["lo"][whole]], [found["hi"][whole] + length]
            ends, spans = batch.column(4).value_lengths().fill_null(0).to_numpy(), batch.column(4).flatten()
            of = np.repeat(np.arange(len(batch)), ends)
            own = batch.column(2).to_numpy()[of] == spans.field("digest").to_numpy()
            shift = offsets[of]
            starts.append((shift + spans.field("start").to_numpy())[own])
            stops.append((shift + spans.field("stop").to_numpy() + length)[own])
            base_at, end_at = int(offsets[0]), int(offsets[-1])
            depth = np.zeros(end_at - base_at + 1, dtype=np.int32)
            np.add.at(depth, np.concatenate(starts) - base_at, 1)
            np.add.at(depth, np.concatenate(stops) - base_at, -1)
            gone = np.cumsum(depth)[:-1] > 0
            removed, runs, digests, kept = [], [], [], []
            for row in range(len(batch)):
                begin, end = int(offsets[row]), int(offsets[row + 1])
                mask = gone[begin - base_at : end - base_at]
                count = int(mask.sum())
                text = data[begin:end]
                rest = text.tobytes() if not count else text[~mask].tobytes()
                removed.append(count)
                runs.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if count else 0)
                digests.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest.decode("utf-8", errors="ignore"))
            columns = [
                pc.if_else(pc.equal(batch.column(0), NO_ID), pa.scalar(None, pa.int64()), batch.column(0)),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = _REMOVED_DDL + (", kept_text string" if texts else "")
    return in_arrow(base.select("id", "text", "digest", "whole", "spans"), run, ddl)


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """Documents (doc_id, text, ...) without the bytes of any ``length``-byte string that starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same row; strings are judged on the input. Returns
    doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept_text (the remaining bytes, without
    characters that were cut in two). Null and empty texts have no bytes. Rows that share a doc_id are not
    earlier than each other. A missing doc_id comes before all others. Other columns are ignored.
    """
    if not ANCHOR < length <= 1024:
        raise ValueError(f"length must be over {ANCHOR} and at most 1024")
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        "text",
        F.xxhash64("text").alias("digest"),
    )
    kinds = anchor_kinds(docs, length)
    again = stage(occurrences(docs, length).join(kinds, "anchor"), "again")
    firsts = again.groupBy("anchor", "segment").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.max("is_open").alias("is_open")
    )
    later = (
        again.join(firsts.where("last > first").select("anchor", "segment", "first"), ["anchor", "segment"])
        .where("id > first")
        .select("id", "segment", F.lit(False).alias("is_open"))
    )
    opened = firsts.where("is_open").select(F.col("first").alias("id"), "segment", "is_open")
    marks = stage(later.union(opened), "marks")
    buckets = marks.where("is_open").count() // BUCKET_ROWS + 1
    by_doc = marks.groupBy("id").agg(
        F.collect_list(F.when(~F.col("is_open"), F.col("segment"))).alias("whole"),
        F.collect_list(F.when(F.col("is_open"), F.col("segment"))).alias("open"),
    )
    base = docs.select("id", "text", "digest").join(by_doc, "id", "left")
    suffixes = open_suffixes(base.where("size(open) > 0"), length)
    found = _resolved(
        suffixes.repartitionByRange(buckets, "suffix", F.reverse(F.hex("before"))), length
    )
    inside = F.when(F.col("cell_a").isNull(), F.col("id"))
    cells = Window.partitionBy("cell_a", "cell_b", inside)
    windows = (
        found.withColumn("n", F.count("*").over(cells))
        .where("cell_a is null or n > 1")
        .select(
            "id",
            "digest",
            "start",
            "stop",
            F.explode_outer(F.arrays_zip(F.col("starts"), F.col("window_a"), F.col("window_b"))).alias("w"),
        )
        .select(
            "id",
            "digest",
            F.coalesce("w.starts", "start").alias("start"),
            F.coalesce("w.starts", "stop").alias("stop"),
            "w.window_a",
            "w.window_b",
        )
    )
    classes = Window.partitionBy("window_a", "window_b", F.when(F.col("window_a").isNull(), F.col("id")))
    spans = (
        windows.withColumn("head", F.min(F.struct("id", "digest", "start")).over(classes))
        .where(
            "window_a is null or id > head.id or (id = head.id and digest = head.digest and start > head.start)"
        )
        .groupBy("id")
        .agg(F.collect_list(F.struct("digest", "start", "stop")).alias("spans"))
    )
    return _removal(base.join(spans, "id", "left"), length, texts)
