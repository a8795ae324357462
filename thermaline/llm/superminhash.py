"""Near-duplicate documents by SuperMinHash signatures, bands, exact verification and components.

A document's set holds its distinct word shingles. Signatures come from correlated ranks: every element
carries one permutation of the ranks 0..127, so no two positions of the signature get the same rank from it,
and position j keeps the least ``rank + fraction`` over all elements. Ranks are handed out in rising order, so
the work stops as soon as every position holds a value below the next rank (mostly after two or three ranks).

Documents that share a band are candidates. No bucket is expanded to all its pairs. Shingles that no other
candidate has bound a document's intersection with any other; documents whose own shingles are too many are
settled by that alone. Of the rest, each member of a bucket is checked against the bucket's centre, the document
with the smallest part of own shingles; the confirmed links are contracted. Then only members that a bucket still
holds in different components are compared, and of these only pairs whose bound admits a link: what both share
with the centre, and at most what each has beyond it. Whatever shares a band is thus
compared exactly, already connected, or proved to be apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.components import components
from thermaline.llm.hashing import mix, row_groups, set_digests, shingle_sets, utf8
from thermaline.llm.tasks import in_arrow
from thermaline.staging import stage

POSITIONS = 128
BAND_ROWS = 4
BANDS = POSITIONS // BAND_ROWS
DENSE_BELOW = 96
GROUP_BYTES = 4 << 20

_FRACTION = np.uint64(32)
_INVERSES = np.array([pow(2 * a + 1, -1, POSITIONS) for a in range(POSITIONS // 2)], dtype=np.uint64)
_RANK_STEP = np.uint64(0xA24BAED4963EE407)
_RANK_STEPS = np.arange(POSITIONS, dtype=np.uint64) * _RANK_STEP
_MASK = np.uint64(POSITIONS - 1)


def _fractions(elements: np.ndarray, ranks: np.ndarray | int) -> np.ndarray:
    return mix(elements + _RANK_STEPS[ranks]) >> _FRACTION


def signature(elements: np.ndarray) -> np.ndarray:
    """The signature of one set of 64-bit elements: 128 values, the upper half of each being the rank."""
    bits = mix(elements ^ _RANK_STEP)
    odd = (bits >> np.uint64(20)) & np.uint64(POSITIONS // 2 - 1)
    shift = (bits >> np.uint64(40)) & _MASK
    if len(elements) < DENSE_BELOW:
        places = np.arange(POSITIONS, dtype=np.uint64)[None, :]
        ranks = ((places - shift[:, None]) * _INVERSES[odd.astype(np.int64)][:, None]) & _MASK
        values = (ranks << _FRACTION) | _fractions(elements[:, None], ranks.astype(np.intp))
        return values.min(axis=0)
    step = np.uint64(2) * odd + np.uint64(1)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for level in range(POSITIONS):
        rank = np.uint64(level)
        place = (step * rank + shift) & _MASK
        np.minimum.at(least, place.astype(np.intp), (rank << _FRACTION) | _fractions(elements, level))
        if int(least.max()) >> 32 <= level:
            break
    return least


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(sets, 128) signatures to (sets, 32) band hashes."""
    parts = signatures.reshape(len(signatures), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :], parts.shape[:2]).copy()
    for i in range(BAND_ROWS):
        out = mix(out * _RANK_STEP + parts[:, :, i])
    return out.view(np.int64)


_SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_a", pa.int64()),
        ("set_b", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)
_SKETCH_DDL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, band hashes (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, after in row_groups(offsets, GROUP_BYTES):
                sets, ends = shingle_sets(data, offsets[first : after + 1], words)
                sizes = np.diff(ends)
                full = np.flatnonzero(sizes)
                signed = np.empty((len(full), POSITIONS), dtype=np.uint64)
                for i, row in enumerate(full):
                    signed[i] = signature(sets[ends[row] : ends[row + 1]])
                a, b = set_digests(sets, ends)
                lengths = np.where(sizes > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                    pa.array(band_hashes(signed).reshape(-1)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, after - first).cast(pa.int64()),
                        pa.array(sizes),
                        pa.array(a),
                        pa.array(b),
                        bands,
                    ],
                    schema=_SKETCH,
                )

    return in_arrow(docs.select("doc_id", "text"), run, _SKETCH_DDL)


def compared(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Adds to pairs (a, b) what their whole sets of shingles say.

    ``linked``: ``100 * intersection >= percent * union``; ``held_bits``: which of a's shingles, in order, b holds;
    ``beyond``: how many shingles of b are not a's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8(batch.column(i)) for i in (2, 3)]
            both = sides[0][1] + sides[1][1]
            for first, after in row_groups(both, GROUP_BYTES):
                (x, xs), (y, ys) = (
                    shingle_sets(data, offsets[first : after + 1], words) for data, offsets in sides
                )
                linked, beyond, held = [], [], []
                for i in range(after - first):
                    u, v = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                    mask = np.isin(u, v, assume_unique=True)
                    common = int(mask.sum())
                    linked.append(100 * common >= percent * (len(u) + len(v) - common))
                    beyond.append(len(v) - common)
                    packed = np.zeros(-(-len(u) // 64) * 8, dtype=np.uint8)
                    packed[: -(-len(u) // 8)] = np.packbits(mask)
                    held.append(packed.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(first, after - first) for i in (0, 1)],
                        pa.array(linked, pa.bool_()),
                        pa.array(held, pa.list_(pa.int64())),
                        pa.array(beyond, pa.int64()),
                    ],
                    names=["a", "b", "linked", "held_bits", "beyond"],
                )

    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return in_arrow(joined, run, "a long, b long, linked boolean, held_bits array<long>, beyond long")


def own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(id, own): how many shingles of each of ``texts`` (id, text) no other id has; ids with none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for first, after in row_groups(offsets, GROUP_BYTES):
                sets, ends = shingle_sets(data, offsets[first : after + 1], words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[first:after], np.diff(ends))), pa.array(sets.view(np.int64))],
                    names=["id", "shingle"],
                )

    holders = in_arrow(texts.select("id", "text"), run, "id long, shingle long").groupBy("shingle")
    single = holders.agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return single.groupBy("id").agg(F.count("*").alias("own"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents (doc_id, text, ...) to (doc_id, n_shingles, component_id, kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Equal sets are one vertex from the start, so copies
    cost a row of an aggregate. Null or empty texts, and texts without words, are linked with nothing. Rows that
    share a doc_id are one vertex, linked by any of its texts. A row without a doc_id has no component and is
    kept. Other columns are ignored. A pair at the threshold is missed with a probability below 1e-9 at 85 % (4.7e-8 at 80 %).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(sketches(docs, words), "sketches")
    known = signed.where("doc_id is not null and n_shingles > 0")
    firsts = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    of_set = known.join(firsts, ["set_a", "set_b"]).select("doc_id", "rep")
    several = of_set.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    bridges = (
        of_set.join(several.where("low < high"), "doc_id")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    reps = known.join(
        firsts.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"]
    )
    members = reps.select(
        F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("band")
    )
    shared = members.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = stage(members.join(shared.select("band"), "band").distinct(), "members")
    texts = docs.withColumnRenamed("doc_id", "id").join(members.select("id").distinct(), "id")
    texts = stage(texts, "texts")
    # An id with several texts has the shingles of all of them; its bound would be wrong for each.
    own = own_shingles(texts, words).join(
        several.where("low < high").select(F.col("doc_id").alias("id")), "id", "left_anti"
    )
    owned = members.join(own, "id", "left").withColumn(
        "held", F.col("n_shingles") - F.coalesce("own", F.lit(0))
    )
    able = stage(
        owned.where(F.col("held") * 100 >= F.col("n_shingles") * percent).select(
            "band", "id", "n_shingles", "held"
        ),
        "able",
    )
    centres = able.groupBy("band").agg(
        F.min_by("id", F.struct((-F.col("held") / F.col("n_shingles")).alias("part"), "id")).alias("centre")
    )
    able = able.join(centres, "band")
    spokes = stage(
        compared(
            able.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(),
            texts,
            words,
            percent,
        ),
        "spokes",
    )
    links = spokes.where("linked").select("a", "b").distinct()
    found = components(links)
    placed = able.join(
        found.select(F.col("vertex").alias("id"), "component"), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))
    split = (
        placed.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("band")
    )
    about = spokes.select(F.col("a").alias("centre"), F.col("b").alias("id"), "held_bits", "beyond")
    placed = stage(
        placed.join(split, "band").join(about, ["centre", "id"]).select(
            "band",
            "id",
            "component",
            "n_shingles",
            "held",
            "held_bits",
            # An own shingle isn't the centre's, nor any other's.
            (F.col("beyond") - (F.col("n_shingles") - F.col("held"))).alias("rest"),
        ),
        "placed",
    )
    left, right = (
        placed.select("band", *[F.col(c).alias(f"{c}_{s}") for c in placed.columns if c != "band"]) for s in "ab"
    )
    both = F.aggregate(
        F.zip_with("held_bits_a", "held_bits_b", lambda x, y: F.bit_count(x.bitwiseAND(y))),
        F.lit(0),
        lambda total, n: total + n,
    )
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    roughly, at_most = F.least("held_a", "held_b"), both + F.least("rest_a", "rest_b")
    apart = (
        left.join(right, "band")
        .where("component_a <> component_b and id_a < id_b")
        .where((roughly * 100 >= percent * (total - roughly)) & (at_most * 100 >= percent * (total - at_most)))
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        .distinct()
    )
    more = compared(apart, texts, words, percent).where("linked").select("a", "b")
    found = components(links.union(more).union(bridges))
    placed_ids = of_set.join(
        found.select(F.col("vertex").alias("rep"), "component"), "rep", "left"
    ).select("doc_id", F.coalesce("component", "rep").alias("component"))
    by_id = placed_ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    return signed.select("doc_id", "n_shingles").join(by_id, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.expr("doc_id is null or doc_id = coalesce(component, doc_id)").alias("kept"),
    )
