"""Quality selection by importance resampling.

Two generative models of hashed word unigrams and bigrams, one of the target text (labelled as good) and one of all raw
text, give each document the log of its importance weight: the mean log ratio of its n-grams, scaled by the root of
their number. Text with a word that tells labelled toxic documents from the others has the weight 0, however long and
good the rest, as one word decides. Documents are drawn without replacement in proportion to their weights by Gumbel top-k: noise is
added to the log weights, and the k largest sums win; k is the number of documents whose weight reaches a cut fitted on
the labelled ones. The k-th largest is found by counting into bins, so no task
sorts or holds all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.hashing import mix, row_groups, utf8, word_hashes
from thermaline.llm.tasks import in_arrow
from thermaline.staging import stage

BUCKETS = 1 << 16
GROUP_BYTES = 4 << 20
#: The mean log ratio of n grams counts ``LENGTH_WEIGHT * sqrt(n)`` times, as neighbouring grams aren't independent
#: draws; so length alone doesn't decide.
LENGTH_WEIGHT = 4.0
SMOOTHING = 1.0
BINS = 4096
#: The target model is fitted on at most so many labelled documents, drawn by hash; the raw model on all documents.
LABELLED = 20_000

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: For the words of the toxic model, ASCII signs other than letters and digits are blanks.
_PLAIN = np.array([b if b > 127 or chr(b).isalnum() else 0x20 for b in range(256)], dtype=np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the word unigrams and bigrams of each row, and the rows."""
    words, rows = word_hashes(data, offsets)
    pairs = mix(words[:-1] * _STEP + words[1:])
    inside = rows[:-1] == rows[1:]
    buckets = np.concatenate([words, pairs[inside]]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([rows, rows[:-1][inside]])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of each row without punctuation, and the rows."""
    start = offsets[0]
    return word_hashes(_PLAIN[data[start : offsets[-1]]], offsets - start)


def toxic_words(labelled: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that mark toxic text.

    ``labelled`` has (text, toxic); rows with a null ``toxic`` are left out. A word is counted once for each pair of
    neighbours of its first place in a text, so copies of one document count once. It marks toxic text if most
    of its places are toxic, and so large a share isn't expected by chance even once among all repeated words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, after in row_groups(offsets, GROUP_BYTES):
                words, rows = plain_words(data, offsets[first : after + 1])
                ends = np.zeros(len(words) + 1, dtype=bool)
                ends[1:-1] = rows[1:] == rows[:-1]
                before = np.where(ends[:-1], np.roll(words, 1), np.uint64(0))
                behind = np.where(ends[1:], np.roll(words, -1), np.uint64(0))
                order = np.lexsort((words, rows))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(rows[order]) != 0) | (words[order][1:] != words[order][:-1])
                at = order[new]
                places = mix(mix(before[at]) * _STEP + behind[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[at].view(np.int64)), pa.array(places.view(np.int64)), pa.array(toxic[first:after][rows[at]])],
                    names=["word", "place", "toxic"],
                )

    labelled = labelled.where("toxic is not null").select("text", "toxic")
    share = labelled.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not share or share == 1.0:
        return np.zeros(0, dtype=np.uint64)
    counts = (
        in_arrow(labelled, run, "word long, place long, toxic boolean")
        .distinct()
        .groupBy("word")
        .agg(F.count_if("toxic").alias("hits"), F.count("*").alias("n"))
        .where("n > 1")
    )
    counts = stage(counts, "toxic-words")
    part = F.col("hits") / F.col("n")
    surprise = F.col("n") * (
        part * F.log(part / share)
        + F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    )
    found = counts.where((part > 0.5) & (part > share) & (surprise > F.log(F.lit(max(1, counts.count())))))
    words = [r.word for r in found.select("word").collect()]
    return np.sort(np.array(words, dtype=np.int64).view(np.uint64))


def holds_any(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each row holds one of the words ``marks``."""
    held = np.zeros(len(offsets) - 1, dtype=bool)
    if len(marks):
        words, rows = plain_words(data, offsets)
        held[rows[marks[np.minimum(np.searchsorted(marks, words), len(marks) - 1)] == words]] = True
    return held


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over those with ``good``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, after in row_groups(offsets, GROUP_BYTES):
                buckets, rows = grams(data, offsets[first : after + 1])
                totals[0] += np.bincount(buckets, minlength=BUCKETS)
                totals[1] += np.bincount(buckets[good[first:after][rows]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(totals[0]), pa.array(totals[1])],
            names=["bucket", "raw", "target"],
        )

    partial = in_arrow(docs.select("text", "good"), run, "bucket int, raw long, target long")
    return partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def models(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The raw and the target count of each of the fixed number of buckets."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in counts.collect():
        raw[bucket], target[bucket] = n, m
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of the two models for each bucket."""
    scale = SMOOTHING * max(1.0, target.sum()) / max(1.0, raw.sum())
    p = (target + scale) / (target.sum() + scale * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def fitted_cut(texts: DataFrame, raw: np.ndarray, target: np.ndarray) -> float:
    """The log weight that tells best good labelled documents from those of quality 0.

    ``texts`` has (doc_id, text, fine, good). A good document is weighed by the target model without itself, as
    documents without a label are. The cut has the largest difference of the two shares that reach it; it lies half-way
    between the weights next to it. Without documents of both kinds it's minus infinity.
    """
    shared = texts.sparkSession.sparkContext.broadcast((raw, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = shared.value
        ratios, total = log_ratios(raw, target), target.sum()
        scale = SMOOTHING * max(1.0, total) / max(1.0, raw.sum())
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            good = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            weight = np.zeros(len(batch))
            for first, after in row_groups(offsets, GROUP_BYTES):
                buckets, rows = grams(data, offsets[first : after + 1])
                sizes = np.bincount(rows, minlength=after - first)
                pairs, own = np.unique(rows * BUCKETS + buckets, return_counts=True)
                row, bucket = pairs // BUCKETS, pairs % BUCKETS
                less = np.where(good[first:after][row], own, 0)
                rest = total - np.where(good[first:after], sizes, 0)
                change = np.log(np.maximum(target[bucket] - less, 0) + scale) - np.log(target[bucket] + scale)
                change += np.log(total + scale * BUCKETS) - np.log(rest + scale * BUCKETS)[row]
                sums = np.bincount(row, weights=own * (ratios[bucket] + change), minlength=after - first)
                weight[first:after] = LENGTH_WEIGHT * sums / np.sqrt(np.maximum(sizes, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(weight)], names=["doc_id", "good", "log_weight"]
            )

    known = in_arrow(
        texts.where("good or not fine").select("doc_id", "text", "good"),
        run,
        "doc_id long, good boolean, log_weight double",
    )
    rows = known.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("log_weight").alias("w")).collect()
    weights = np.array([r.w for r in rows])
    good = np.array([r.good for r in rows], dtype=bool)
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    below = np.cumsum(np.where(good, -1.0 / good.sum(), 1.0 / (~good).sum()))
    ends = np.append(np.diff(weights) > 0, False)
    if not ends.any() or below[ends].max() <= 0:
        return float("-inf")
    at = int(np.argmax(np.where(ends, below, -np.inf)))
    return float((weights[at] + weights[at + 1]) / 2)


def weighed(docs: DataFrame, ratios: np.ndarray, marks: np.ndarray) -> DataFrame:
    """(doc_id, good, digest, n_grams, log_weight) of each row; ``marks`` are the toxic words."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios.astype(np.float64), marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, marks = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            sums, sizes, toxic = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), dtype=bool)
            for first, after in row_groups(offsets, GROUP_BYTES):
                buckets, rows = grams(data, offsets[first : after + 1])
                sums[first:after] = np.bincount(rows, weights=table[buckets], minlength=after - first)
                sizes[first:after] = np.bincount(rows, minlength=after - first)
                toxic[first:after] = holds_any(data, offsets[first : after + 1], marks)
            weight = np.where(toxic, -np.inf, LENGTH_WEIGHT * sums / np.sqrt(np.maximum(sizes, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes.astype(np.int64)), pa.array(weight)],
                names=["doc_id", "good", "digest", "n_grams", "log_weight"],
            )

    rows = docs.select("doc_id", "text", "good", F.xxhash64("text").alias("digest"))
    return in_arrow(rows, run, "doc_id long, good boolean, digest long, n_grams long, log_weight double")


def top_threshold(rows: DataFrame, column: str, k: int) -> float:
    """A value that the k largest of ``column`` reach, and few or no others: exact but for ties.

    Each pass counts the rows of the interval in question in a fixed number of bins and goes on in one of them.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    for _ in range(6):
        width = (high - low) / BINS
        if width <= 0 or low + width <= low:
            break
        bin_of = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = rows.where(F.col(column).between(low, high))
        counts = sorted(inside.groupBy(bin_of.alias("bin")).count().collect(), reverse=True)
        for place, count in counts:
            if above + count >= k:
                break
            above += count
        low, high = low + width * place, min(high, low + width * (place + 1))
        if count == 1:
            break
    return low


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11) -> DataFrame:
    """The sampled documents (doc_id, log_weight, score, n_grams), drawn from (doc_id, text, ...).

    ``labels`` (doc_id, quality, toxic) names the target text: rows with quality 1 that aren't toxic; a null toxic isn't.
    ``share`` of the documents is drawn; if None, as many as have a weight that reaches ``fitted_cut``. A document
    without words has the weight 1 of the raw model.
    Labels of unknown documents, null labels and repeated ones count once at most; a document with labels of both kinds
    is not target text, and toxic. Text with a word that marks toxic text (``toxic_words``) has the weight 0 and is never drawn. Repeated
    rows get the same noise and go together; ties at the threshold are all drawn. A null doc_id is never labelled. Without any good label all weights are equal. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "toxic" not in labels.columns:
        labels = labels.withColumn("toxic", F.lit(None).cast("int"))
    known = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 1).alias("fine"), (F.max("toxic") == 1).alias("toxic"))
        .withColumn("good", F.when(F.col("toxic"), F.lit(False)).otherwise(F.col("fine")))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"))
        .limit(LABELLED)
    )
    known = stage(known, "labelled")
    marked = docs.join(F.broadcast(known), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("good", F.lit(False)).alias("good")
    )
    texts = stage(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "fine", "good", "toxic"), "labelled-texts")
    raw, target = models(gram_counts(marked))
    rows = stage(weighed(marked, log_ratios(raw, target), toxic_words(texts)), "weights")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "digest"), 11) + 0.5) / float(1 << 53)
    scored = rows.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform)))
    if share is None:
        k = rows.where((F.col("log_weight") >= fitted_cut(texts, raw, target)) & (F.col("log_weight") > float("-inf"))).count()
    else:
        k = round(share * rows.count())
    scored = scored.where(F.col("log_weight") > float("-inf"))
    return scored.where(F.col("score") >= top_threshold(scored, "score", k)).select(
        "doc_id", "log_weight", "score", "n_grams"
    )
