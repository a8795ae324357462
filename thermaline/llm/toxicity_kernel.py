"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel compares two units (words, or short windows of long ones) by their common subsequences of three letters: each
place of a subsequence counts ``DECAY`` to the power of the length it spans, so letters may be torn apart or have others
between them, at a price. It is divided by what strings of the same numbers of letters would have with themselves if all
letters differed. The beginning and the end of a unit count as letters. Signs between letters only widen gaps; letters that stand alone one after the other (``i d i o t``) form
one unit.

Documents are labelled, units aren't. Sentences pass the labels on: a unit marks toxic text if its distinct places, told
apart by its neighbours in the sentence, are toxic far beyond chance. Those units, and variants with letters or signs put in,
are the positive examples; units of clean sentences the negative ones, the hardest of which are looked for with a first machine. Kernel values with a bounded
number of landmarks give each example its Nyström features; a linear machine is fitted on them.

A fitted machine is a sum of kernels with the landmarks, hence linear in subsequences: the sum is put into one table of
weights per subsequence, with the same values as the kernels have, so a document costs no more for many landmarks. A
document is described by the margins of its three worst distinct units, as one alone may be there by chance; a logistic
curve fitted on the labelled documents turns them into a score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.llm.hashing import SPACE, mix, powers, row_groups, utf8
from thermaline.llm.tasks import in_arrow
from thermaline.staging import stage, staging_scope

#: The machine is fitted on at most so many labelled documents, drawn by hash.
LABELLED = 20_000
#: Bounds of the units used as examples, for each kind, and of the landmarks.
POSITIVE, NEGATIVE, HARD, VARIANTS, LANDMARKS = 400, 4_000, 2_000, 6_000, 384
DECAY = 0.7
SPAN = 8
#: Longer units are cut into windows of so many bytes, each half over the one before.
UNIT_BYTES = 24
#: Weight of an altered positive example, and of all positive examples against the negative ones.
ALTERED, BALANCE, COST = 0.3, 0.5, 20_000.0
GROUP_BYTES = 2 << 20
SYMBOLS = 64
WORST = 3
MARGINS = [f"margin_{i}" for i in range(1, WORST + 1)]

#: Codes of bytes: 0 for signs, then the letters of either case, digits, and other letters' bytes.
_CODE = np.zeros(256, dtype=np.int64)
for _letter in range(26):
    _CODE[[0x41 + _letter, 0x61 + _letter]] = 1 + _letter
_CODE[0x30:0x3A] = 27
_CODE[0x80:] = 28 + np.arange(128) % 34
_BEGIN, _END = SYMBOLS - 2, SYMBOLS - 1
_HEAD = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _norms(letters: np.ndarray) -> np.ndarray:
    """The root of the kernel of a string of so many different letters with itself; at least that of three."""
    letters = np.maximum(letters, 3)
    total = np.zeros(len(letters))
    for span in range(3, SPAN + 1):
        total += np.maximum(letters - span + 1, 0) * (span - 2) * DECAY ** (2.0 * span)
    return np.sqrt(total)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, rows) of the units of many texts in ``data``, in text order."""
    start, end = int(offsets[0]), int(offsets[-1])
    text = data[start:end]
    at = np.flatnonzero(_CODE[text])
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return none, none, none
    rows = np.searchsorted(offsets - start, at, side="right") - 1
    blanks = np.cumsum(SPACE[text])[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(blanks) != 0) | (np.diff(rows) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    begins, ends, rows = at[first], at[last] + 1, rows[first]
    # Letters that stand alone, three or more in a row, are one unit.
    alone = np.add.reduceat(_HEAD[text[at]].astype(np.int64), first) == 1
    follows = np.zeros(len(first), dtype=bool)
    follows[1:] = alone[1:] & alone[:-1] & (rows[1:] == rows[:-1])
    heads = np.flatnonzero(~follows)
    sizes = np.diff(np.append(heads, len(first)))
    joined = np.repeat(sizes >= 3, sizes) & follows
    heads = np.flatnonzero(~joined)
    begins, ends, rows = begins[heads], ends[np.append(heads[1:], len(first)) - 1], rows[heads]
    long = ends - begins > UNIT_BYTES
    if long.any():
        step = UNIT_BYTES // 2
        count = np.where(long, -(-(ends - begins - UNIT_BYTES) // step) + 1, 1)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begins = np.repeat(begins, count) + place * step
        ends, rows = np.minimum(np.repeat(ends, count), begins + UNIT_BYTES), np.repeat(rows, count)
        ends = np.where(np.repeat(long, count), ends, np.maximum(ends, begins))
    return begins + start, ends + start, rows


def unit_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the codes of each unit."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    start = int(begins[0])
    codes = _CODE[data[start : int(ends.max())]].astype(np.uint64) + np.uint64(1)
    power, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * power, out=sums[1:])
    return mix((sums[ends - start] - sums[begins - start]) * inverse[begins - start] + (ends - begins).astype(np.uint64))


def _codes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of units end to end, and their offsets."""
    sizes = ends - begins
    stops = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(int(stops[-1])) + np.repeat(begins - stops[:-1], sizes)
    return _CODE[data[places]], stops


def framed(codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same units with codes for their beginnings and ends."""
    sizes = np.diff(stops)
    out = np.full(len(codes) + 2 * len(sizes), _END, dtype=np.int64)
    begins = stops[:-1] + 2 * np.arange(len(sizes))
    out[begins] = _BEGIN
    out[np.arange(len(codes)) + np.repeat(begins + 1 - stops[:-1], sizes)] = codes
    return out, np.append(begins, len(out))


def subsequences(codes: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit numbers, subsequences of three letters, weight) for each pair of gaps."""
    owner = np.repeat(np.arange(len(stops) - 1), np.diff(stops))
    room = stops[1:][owner] - np.arange(len(codes))
    for a, b in _PAIRS:
        at = np.flatnonzero(room > b)
        one, two, three = codes[at], codes[at + a], codes[at + b]
        whole = (one > 0) & (two > 0) & (three > 0)
        ids = (one * SYMBOLS + two) * SYMBOLS + three
        yield owner[at[whole]], ids[whole], DECAY ** (b + 1)


def letters_of(codes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(codes > 0)])
    return sums[stops[1:]] - sums[stops[:-1]]


def margins(codes: np.ndarray, stops: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each unit."""
    total = np.zeros(len(stops) - 1)
    for owner, ids, weight in subsequences(codes, stops):
        total += weight * np.bincount(owner, weights=table[ids], minlength=len(total))
    return total / _norms(letters_of(codes, stops)) + bias


def worst_margins(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The ``WORST`` largest values of the distinct units of each text; the machine's constant where there are fewer."""
    worst = np.full((len(offsets) - 1, WORST), bias)
    for first, after in row_groups(offsets, GROUP_BYTES):
        begins, ends, rows = units(data, offsets[first : after + 1])
        if not len(begins):
            continue
        _, head, back = np.unique(unit_hashes(data, begins, ends), return_index=True, return_inverse=True)
        values = margins(*framed(*_codes(data, begins[head], ends[head])), table, bias)
        ranked = np.argsort(-values, kind="stable")
        place = np.empty(len(ranked), dtype=np.int64)
        place[ranked] = np.arange(len(ranked))
        pairs = np.unique(rows * len(ranked) + place[back])
        rows, places = pairs // len(ranked), pairs % len(ranked)
        starts = np.flatnonzero(np.append(True, np.diff(rows) != 0))
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        kept = nth < WORST
        worst[first + rows[kept], nth[kept]] = values[ranked[places[kept]]]
    return worst


def _encoded(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    stops = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    return framed(_CODE[np.frombuffer(b"".join(strings), dtype=np.uint8)], stops)


def kernel(strings: Sequence[bytes], landmarks: Sequence[bytes]) -> np.ndarray:
    """The normalised kernel of each string with each landmark."""
    codes, stops = _encoded(landmarks)
    parts = list(subsequences(codes, stops))
    known = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *[ids for _, ids, _ in parts]]))
    features = np.zeros((len(known), len(landmarks)))
    for owner, ids, weight in parts:
        np.add.at(features, (np.searchsorted(known, ids), owner), weight)
    features /= _norms(letters_of(codes, stops))
    place = np.full(SYMBOLS**3, -1, dtype=np.int64)
    place[known] = np.arange(len(known))
    out = np.zeros((len(strings), len(landmarks)))
    for begin in range(0, len(strings), 128):
        codes, stops = _encoded(strings[begin : begin + 128])
        found = [(owner, place[ids], np.full(len(ids), weight)) for owner, ids, weight in subsequences(codes, stops)]
        owner, at, weight = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(owner, kind="stable")
        order = order[at[order] >= 0]
        if len(order):
            owner = owner[order]
            first = np.flatnonzero(np.append(True, np.diff(owner) != 0))
            out[begin + owner[first]] = np.add.reduceat(features[at[order]] * weight[order, None], first)
        out[begin : begin + 128] /= _norms(letters_of(codes, stops))[:, None]
    return out


def altered(unit: bytes) -> list[bytes]:
    """Variants of a unit with a letter put in or doubled at each inner place, and with signs between all letters."""
    inner = range(1, len(unit))
    found = [unit[:i] + bytes([letter]) + unit[i:] for i in inner for letter in b"aehrx"]
    found += [unit[:i] + unit[i - 1 : i] + unit[i:] for i in range(1, len(unit) + 1)]
    found += [unit[:i] + b"-" + unit[i:] for i in inner]
    return [*found, b"-".join(bytes([b]) for b in unit)]


def _machine(features: np.ndarray, signs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    solution = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + 0.5 * (weights * np.maximum(0.0, 1 - signs * (x @ w)) ** 2).sum()

    for _ in range(50):
        gap = 1 - signs * (x @ solution)
        inside = gap > 0
        gradient = ridge * solution - x[inside].T @ (weights[inside] * signs[inside] * gap[inside])
        curved = (x[inside] * weights[inside, None]).T @ x[inside] + np.diag(ridge)
        step, size, now = np.linalg.solve(curved, gradient), 1.0, loss(solution)
        while size > 1e-4 and loss(solution - size * step) > now:
            size /= 2
        solution = solution - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return solution[:-1], float(solution[-1])


def fitted(positive: Sequence[bytes], negative: Sequence[bytes]) -> tuple[np.ndarray, float]:
    """Weights of subsequences and a constant, from examples of both kinds."""
    more = [variant for unit in positive for variant in altered(unit)]
    more = more[:: -(-len(more) // VARIANTS) or 1]
    examples = [*positive, *more, *negative]
    signs = np.array([1.0] * (len(positive) + len(more)) + [-1.0] * len(negative))
    weights = np.array([1.0] * len(positive) + [ALTERED] * len(more) + [1.0] * len(negative))
    weights[signs > 0] *= BALANCE / weights[signs > 0].sum()
    weights[signs < 0] *= (1 - BALANCE) / weights[signs < 0].sum()
    landmarks = [*positive[: LANDMARKS // 2]]
    landmarks += negative[: LANDMARKS - len(landmarks)]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    kept = values > 1e-6 * values.max()
    turn = vectors[:, kept] / np.sqrt(values[kept])
    slope, bias = _machine(kernel(examples, landmarks) @ turn, signs, COST * weights)
    shares = turn @ slope
    codes, stops = _encoded(landmarks)
    shares = shares / _norms(letters_of(codes, stops))
    table = np.zeros(SYMBOLS**3)
    for owner, ids, weight in subsequences(codes, stops):
        table += weight * np.bincount(ids, weights=shares[owner], minlength=len(table))
    return table, bias


def unit_places(texts: DataFrame) -> DataFrame:
    """(unit, n, hits): the distinct places of each unit in sentences, and how many of them are in toxic text only.

    ``texts`` has (text, toxic). A place is the pair of units before and behind in the same sentence, so copies, near
    ones too, count once. A place that occurs in documents of both kinds isn't toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, after in row_groups(offsets, GROUP_BYTES):
                begins, ends, rows = units(data, offsets[first : after + 1])
                if not len(begins):
                    continue
                start = int(offsets[first])
                stops = np.cumsum(_STOP[data[start : int(offsets[after])]])[begins - start]
                hashes = unit_hashes(data, begins, ends)
                same = np.append(False, (np.diff(stops) == 0) & (np.diff(rows) == 0))
                before = np.where(same, np.roll(hashes, 1), np.uint64(0))
                behind = np.where(np.append(same[1:], False), np.roll(hashes, -1), np.uint64(0))
                places = mix(mix(before + hashes * powers(4)[0][3]) * powers(4)[0][1] + behind)
                _, at = np.unique(mix(places + rows.astype(np.uint64)), return_index=True)
                codes, parts = _codes(data, begins[at], ends[at])
                spelled = _SPELL[codes].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.Array.from_buffers(
                            pa.binary(), len(at), [None, pa.py_buffer(parts.astype(np.int32)), pa.py_buffer(spelled)]
                        ),
                        pa.array(places[at].view(np.int64)),
                        pa.array(toxic[first:after][rows[at]]),
                    ],
                    names=["unit", "place", "toxic"],
                )

    held = in_arrow(texts.select("text", "toxic"), run, "unit binary, place long, toxic boolean")
    held = held.groupBy("unit", "place").agg(F.min("toxic").alias("toxic"))
    return held.groupBy("unit").agg(F.count("*").alias("n"), F.count_if("toxic").alias("hits"))


#: A byte for each code: units are told apart by their codes alone.
_SPELL = np.zeros(SYMBOLS, dtype=np.uint8)
for _byte in range(255, -1, -1):
    _SPELL[_CODE[_byte]] = _byte
_SPELL[0], _SPELL[1:27] = ord("-"), np.arange(0x61, 0x7B)


def _unit_margins(found: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast((table, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            codes = _CODE[data[offsets[0] : offsets[-1]]]
            values = margins(*framed(codes, offsets - offsets[0]), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["unit", "margin"])

    return in_arrow(found.select("unit"), run, "unit binary, margin double")


def _margins(texts: DataFrame, keep: Sequence[str], table: np.ndarray, bias: float) -> DataFrame:
    """The columns ``keep`` and the margins of each row of (text, ...), worst first."""
    shared = texts.sparkSession.sparkContext.broadcast((table, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            values = worst_margins(data, offsets, *shared.value)
            columns = [*batch.columns[1:], *[pa.array(column) for column in values.T]]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *MARGINS])

    rows = texts.select("text", *keep)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema.fields[1:])
    return in_arrow(rows, run, ", ".join([schema, *[f"{name} double" for name in MARGINS]]))


def logistic(values: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(slopes, constant) of the curve of the share of toxic documents over margins, with smoothed targets."""
    yes, no = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.hstack([values, np.ones((len(values), 1))])
    ridge = np.array([0.1] * values.shape[1] + [1e-6])
    solution = np.append(np.zeros(values.shape[1]), np.log((yes + 1) / (no + 1)))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ solution, -500, 500)))
        gradient = x.T @ (p - target) + ridge * solution
        curved = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.clip(np.linalg.solve(curved, gradient), -2, 2)
        solution = solution - step
        if np.abs(step).max() < 1e-9:
            break
    return solution[:-1], float(solution[-1])


def toxic_units(counts: DataFrame, share: float) -> list[bytes]:
    """Units most of whose places are toxic, beyond what chance gives even one of all units; best first."""
    repeated = counts.where("n > 1")
    part = F.col("hits") / F.col("n")
    surprise = F.col("n") * (
        part * F.log(part / share) + F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    )
    least = float(np.log(max(1, repeated.count())))
    found = repeated.where((F.length("unit") >= 3) & (part > 0.5) & (part > share) & (surprise > least))
    return [bytes(r.unit) for r in found.orderBy(surprise.desc(), "unit").limit(POSITIVE).select("unit").collect()]


class Machine:
    """A fitted scorer of texts: weights of subsequences, constant, slopes and constant of the curve."""

    def __init__(self, table: np.ndarray, bias: float, slopes: Sequence[float], constant: float):
        self.table, self.bias, self.slopes, self.constant = table, bias, list(slopes), constant

    def score(self) -> Column:
        total = F.lit(self.constant)
        for name, slope in zip(MARGINS, self.slopes):
            total = total + F.col(name) * F.lit(float(slope))
        return 1 / (1 + F.exp(-total))


def trained(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Machine:
    """A machine fitted on documents (doc_id, text) labelled by (doc_id, toxic).

    At most ``LABELLED`` documents, drawn by a hash of the id, take part. Null ids and labels and documents with labels
    of both kinds are left out. Without documents of both kinds, or without units that mark toxic text, every text has
    the smoothed share of toxic documents as its score.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"))
        .where("least = most")
        .select("doc_id", (F.col("most") == 1).alias("toxic"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"))
        .limit(LABELLED)
    )
    known = stage(known, "toxic-labels")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = stage(docs.join(F.broadcast(known), "doc_id"), "toxic-texts")
    yes, no = texts.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    flat = Machine(np.zeros(SYMBOLS**3), 0.0, [0.0] * WORST, float(np.log((yes + 1) / (no + 1))))
    if not yes or not no:
        return flat
    counts = stage(unit_places(texts), "toxic-units")
    total, hits = counts.agg(F.sum("n"), F.sum("hits")).first()
    if not hits or hits == total:
        return flat
    positive = toxic_units(counts, hits / total)
    clean = counts.where("2 * hits < n").select("unit")
    by_hash = F.xxhash64(F.lit(seed), "unit")
    drawn = [bytes(r.unit) for r in clean.orderBy(by_hash, "unit").limit(NEGATIVE).collect()]
    if not positive or not drawn:
        return flat
    table, bias = fitted(positive, drawn)
    hardest = _unit_margins(clean, table, bias).orderBy(F.desc("margin"), "unit").limit(HARD).collect()
    table, bias = fitted(positive, [*[bytes(r.unit) for r in hardest], *drawn])
    found = _margins(texts, ["toxic"], table, bias).toArrow()
    values = np.stack([found.column(name).to_numpy() for name in MARGINS], axis=1)
    return Machine(table, bias, *logistic(values, found.column("toxic").to_numpy().astype(bool)))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Every document's toxicity: (doc_id, held_out, score, predicted).

    ``docs`` has (doc_id, text), ``labels`` (doc_id, toxic); other columns are ignored. Labels of ids for which
    ``held_out``, a condition on doc_id, holds aren't learned from; see ``trained`` for the others. score runs from 0
    to 1; predicted is 1 from 0.5 on. A null or empty text has the score of a text without units. Each row is scored for
    itself, repeated rows alike; a null doc_id stays null and isn't held out. An empty table gives no rows.
    """
    learned = labels.where(~F.coalesce(held_out, F.lit(False)))
    with staging_scope(docs.sparkSession):
        machine = trained(docs, learned)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    scored = _margins(rows, ["doc_id", "held_out"], machine.table, machine.bias)
    return scored.withColumn("score", machine.score()).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
