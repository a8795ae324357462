from __future__ import annotations

import math

import numpy as np
import pytest
from llm import cases  # noqa: F401
from pyspark.sql import functions as F

from thermaline.llm import mtree, queries
from thermaline.llm.mtree import Page, top_inner_products

SCHEMA = "vec_id long, v array<long>, route string, page_number string, ids string"


def brute(rows, k, is_query):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.int64)
    out = []
    for query_id, query in zip(ids.tolist(), vectors):
        if is_query(query_id):
            scores = vectors @ query
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query_id][:k]
            out += [(query_id, n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(order)]
    return sorted(out)


def found(spark, rows, k):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_inner_products(df, F.col("vec_id") % 20 == 0, k).collect()))


@pytest.mark.parametrize("page_rows, block", [(4096, 256), (40, 3)])
def test_like_brute_force_with_ties_and_a_hot_vector(spark, monkeypatch, page_rows, block):
    monkeypatch.setattr(mtree, "PAGE_ROWS", page_rows)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", block)
    rng = np.random.default_rng(page_rows)
    centres = rng.integers(-40, 40, (6, 8))
    vectors = [
        [3] * 8 if i % 3 == 0 else (centres[i % 6] + rng.integers(-4, 4, 8)).tolist() for i in range(500)
    ]
    rows = list(enumerate(vectors))
    assert found(spark, rows, 7) == brute(rows, 7, lambda i: i % 20 == 0)


def test_fewer_rows_than_ranks_and_zero_vectors(spark):
    rows = [(0, [0, 0]), (1, [0, 0]), (20, [5, 1])]
    assert found(spark, rows, 20) == brute(rows, 20, lambda i: i % 20 == 0)


def test_awkward_rows(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (2, None), (None, [9, 9]), (3, [1, None]), (4, [1, 2, 3]), (5, []), (40, [2, 2]), (40, [2, 2])]
    got = found(spark, rows, 3)
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 11), (0, 2, 40, 6), (0, 3, 40, 6)]
    assert [r for r in got if r[0] == 40] == [(40, 1, 1, 14), (40, 2, 0, 6)]


def test_empty_table(spark):
    assert found(spark, [], 3) == []


def test_the_query_leaves_out_vectors_that_are_not_finite(spark, tmp_path):
    vectors = [(i, [float(i % 7) / 8, -0.01 * i]) for i in range(60)]
    vectors += [(60, [math.nan, 1.0]), (61, [math.inf, 1.0]), (62, [None, 1.0]), (63, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors[:60]]
    got = sorted(map(tuple, queries.mtree_search(spark, str(tmp_path)).collect()))
    assert got == brute(rows, 20, lambda i: i % 20 == 0)


def test_most_entries_are_not_computed():
    """On clustered vectors the stored distances spare most inner products, and none that counts."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (64, 16))
    vectors = np.repeat(centres, 60, axis=0) + rng.integers(-20, 20, (64 * 60, 16))
    largest = int((vectors**2).sum(axis=1).max())
    page = Page.built(np.arange(len(vectors)), vectors, largest)
    computed = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            computed.append(len(self))
            return np.asarray(self) @ other

    page.vectors = page.vectors.view(Counted)
    for at in range(0, len(vectors), 333):
        got = page.search(vectors[at], at, 5, mtree.NONE)
        scores = vectors @ vectors[at]
        scores[at] = -(2**62)
        assert [s for s, _ in got] == sorted(scores.tolist(), reverse=True)[:5]
    assert np.mean(computed) * 12 < len(vectors) * 12 and sum(computed) < 0.5 * len(vectors) * len(range(0, len(vectors), 333))


def test_pages_are_dropped_before_they_are_joined(spark):
    """On clustered vectors the directory alone rules out most pages, and what is left gives the exact result."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (32, 8))
    vectors = np.repeat(centres, 40, axis=0) + rng.integers(-10, 10, (32 * 40, 8))
    largest, width = int((vectors**2).sum(axis=1).max()), 8
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, v array<long>")
    routes = mtree._routes(mtree._lifted(vectors, largest), 32)
    placed = mtree.assigned(df, routes, width, largest)
    pages = mtree.pages_of(placed, width, 40, largest)
    blocks = mtree.blocks_of(placed.where("vec_id % 20 = 0"), width, 2)
    bounds = {i: int(np.sort(vectors @ vectors[i])[-6]) for i in range(0, len(vectors), 20)}
    known = spark.createDataFrame([(bounds,)], "m map<long, long>")
    bounded = blocks.join(known).selectExpr("block", "query_ids", "queries", "transform(query_ids, q -> m[q]) as bounds")
    pairs = mtree.admitted(bounded, pages, routes, width, largest)
    assert 0 < pairs.count() < 0.5 * pages.count() * blocks.count()
    got = sorted(tuple(r) for r in mtree._hits(mtree.searched(pairs, bounded, pages, width, 5, largest)).collect())
    for i in bounds:
        scores = sorted((int(s) for j, s in enumerate(vectors @ vectors[i]) if j != i), reverse=True)[:5]
        assert sorted((s for q, _, s in got if q == i), reverse=True)[:5] == scores


def test_sums_beyond_the_whole_numbers_of_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-(2**29), 2**29, 4)).tolist()) for i in range(60)]
    assert found(spark, rows, 5) == brute(rows, 5, lambda i: i % 20 == 0)
