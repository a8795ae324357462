"""Exact top-k inner-product search in an M-tree.

Vectors become points of a metric space in which the nearest neighbour is the largest inner product: one coordinate,
the root of (largest squared norm - squared norm), is added to each vector, and 0 to each query.

The tree has three levels. Routing objects are drawn from a bounded sample; every vector goes to its nearest one and keeps
the distance to it. The vectors of a routing object, ordered by that distance, are cut into pages of a bounded number of
rows (a hot object gets as many pages as it needs). A page keeps its centre and covering radius and the range of its rows'
parent distances; it holds leaf nodes, again with centres, radii and the distance of each entry to its leaf's centre.

Queries come in blocks. The directory, a row of stored distances for each page, is read first, without the pages: for each
block it names the page with the smallest lower bound, and that page alone is searched. The scores found bound the other
pages: a page whose stored radius and parent distances can't serve any query of a block is dropped before pages are
joined. In a page, leaves are visited best first, and entries are computed if their stored distance admits them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.tasks import in_arrow
from thermaline.staging import stage, staging_scope

SAMPLE = 4096
MAX_ROUTES = 1024
PAGE_ROWS = 4096
LEAF_ROWS = 64
QUERY_BLOCK = 2048
#: Pages in a row of the directory as it meets query blocks.
CHUNK_PAGES = 1024
#: Blocks whose best scores a task remembers from page to page.
REMEMBERED = 32
NONE = -(2**62)


def _routes(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` routing objects, each the sampled vector farthest from those before it."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen = [0]
    distance = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen].astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer-valued rows; exact in doubles below 2**53."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _lifted(vectors: np.ndarray, largest: int) -> np.ndarray:
    """Points of the metric space; a query's last coordinate is 0 instead."""
    points = vectors.astype(np.float64)
    lift = np.sqrt(np.maximum(0.0, float(largest) - (points * points).sum(axis=1)))
    return np.concatenate([points, lift[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, _squares(a, b)))


def assigned(vectors: DataFrame, routes: np.ndarray, width: int, largest: int) -> DataFrame:
    """Adds the nearest routing object and the distance to it to rows of (vec_id, v)."""
    shared = vectors.sparkSession.sparkContext.broadcast(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = _distances(_lifted(_matrix(batch.column(1), width), largest), shared.value)
                near = far.argmin(axis=1)
                columns = [pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *columns], names=["vec_id", "v", "route", "distance"]
                )

    return in_arrow(vectors, run, "vec_id long, v array<long>, route int, distance double")


class Page:
    """The leaf nodes of one page, in the metric space of ``largest`` squared norm.

    Rows stand in leaf order; ``parents`` holds each row's distance to the centre of its leaf. Vectors are doubles while
    inner products are exact in them, and whole numbers beyond.
    """

    def __init__(self, ids, vectors, leaf_sizes, centres, parents, largest):
        self.ids, self.parents, self.largest = ids, parents, largest
        self.kind = np.float64 if largest < 2**52 else np.int64
        self.vectors = vectors.reshape(len(ids), -1).astype(self.kind)
        self.leaf_sizes, self.centres = leaf_sizes, centres.reshape(len(leaf_sizes), -1)
        self.ends = np.cumsum(leaf_sizes)
        self.radii = np.array([parents[e - n : e].max() for e, n in zip(self.ends, leaf_sizes)])

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray, largest: int) -> Page:
        points = _lifted(vectors, largest)
        seeds = _routes(points[np.lexsort((*vectors.T[:1], ids))], max(1, -(-len(ids) // LEAF_ROWS)))
        near = _squares(points, seeds).argmin(axis=1)
        order = np.lexsort((ids, near))
        ids, vectors, points, near = ids[order], vectors[order], points[order], near[order]
        _, begin, sizes = np.unique(near, return_index=True, return_counts=True)
        centres = np.add.reduceat(points, begin, axis=0) / sizes[:, None]
        parents = np.sqrt(((points - np.repeat(centres, sizes, axis=0)) ** 2).sum(axis=1))
        return cls(ids, vectors, sizes, centres, parents, largest)

    def search(self, query: np.ndarray, own: int, k: int, bound: int) -> list[tuple[int, int]]:
        """The best (score, id) of this page for one query that reach ``bound``; rows ``own`` are left out."""
        best = Best(1, k, np.array([bound]))
        self.search_block(query[None, :], np.array([own]), best)
        _, ids, scores = best.hits()
        return list(zip(scores.tolist(), ids.tolist()))

    def search_block(self, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Adds this page's rows to the best of each query; rows with the query's id ``own`` are left out.

        A score s and a distance d of lifted points have d * d = largest + |q|**2 - 2 * s, so a bound on the score is a
        bound on the distance. Distances get a little slack for rounding; scores themselves are whole numbers.
        """
        points = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
        queries = queries.astype(self.kind)
        to_centres = _distances(points, self.centres)
        nearest = to_centres - self.radii
        for leaf in np.argsort(nearest.min(axis=0), kind="stable"):
            reach = reaches(points, best.bounds, self.largest)
            active = np.flatnonzero(nearest[:, leaf] <= reach)
            if not len(active):
                continue
            begin, end = self.ends[leaf] - self.leaf_sizes[leaf], self.ends[leaf]
            gap = np.abs(to_centres[active, leaf][:, None] - self.parents[begin:end]) <= reach[active][:, None]
            rows = begin + np.flatnonzero(gap.any(axis=0))
            if len(rows):
                scores = np.asarray(self.vectors[rows] @ queries[active].T).T.astype(np.int64)
                best.add(active, scores, self.ids[rows], own)


class Best:
    """The k best scores of each query of a block, and the rows that have them."""

    def __init__(self, size: int, k: int, bounds: np.ndarray):
        self.k, self.bounds = k, bounds.astype(np.int64).copy()
        self.scores = np.full((size, k), NONE, dtype=np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        scores[ids[None, :] == own[active][:, None]] = NONE - 1
        both = np.concatenate([self.scores[active], scores], axis=1)
        top = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.scores[active] = top
        self.bounds[active] = np.maximum(self.bounds[active], top.min(axis=1))
        at, column = np.nonzero(scores >= np.maximum(self.bounds[active], NONE)[:, None])
        self.found.append((active[at], ids[column], scores[at, column]))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, scores) added since the last call: at most k for each query, those that still count."""
        if not self.found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at, ids, scores = (np.concatenate(part) for part in zip(*self.found))
        self.found = []
        kept = scores >= self.bounds[at]
        at, ids, scores = at[kept], ids[kept], scores[kept]
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        first = np.flatnonzero(np.append(True, np.diff(at) != 0)) if len(at) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        return at[nth < self.k], ids[nth < self.k], scores[nth < self.k]


def reaches(points: np.ndarray, bounds: np.ndarray, largest: int) -> np.ndarray:
    """The largest distance at which an entry can still have a score of ``bounds``."""
    base = float(largest) + (points * points).sum(axis=1)
    reach = np.sqrt(np.maximum(0.0, base - 2.0 * bounds)) + 1e-6 * (1 + np.sqrt(base))
    return np.where(bounds > NONE, reach, np.inf)


def _runs(rows: DataFrame, width: int, size: int, make, schema: str, names: list[str]) -> DataFrame:
    """``make(ids, vectors, distances, route)`` on runs of at most ``size`` rows of one routing object.

    Rows are dealt to tasks by ranges of (route, distance); ties go by a hash, so a hot vector fills many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, route = [], 0, None

        def flushed():
            ids, vectors, distances = (np.concatenate(part) for part in zip(*held))
            columns = [pa.array([value]) for value in make(ids, vectors, distances, route)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            routes = batch.column(2).to_numpy()
            begin = 0
            while begin < len(batch):
                if held and (routes[begin] != route or count == size):
                    yield flushed()
                    held, count = [], 0
                route = int(routes[begin])
                changed = np.flatnonzero(routes[begin:] != route)
                end = min(begin + size - count, begin + int(changed[0]) if len(changed) else len(batch))
                part = batch.slice(begin, end - begin)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1), width), part.column(3).to_numpy()))
                count, begin = count + end - begin, end
        if held:
            yield flushed()

    rows = rows.select("vec_id", "v", "route", "distance")
    parts = max(1, rows.count() // (4 * size))
    order = ["route", "distance", F.xxhash64("vec_id", "v")]
    return in_arrow(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), run, schema)


_PAGE = ["route", "low", "high", "centre", "radius", "ids", "vectors", "leaf_sizes", "centres", "parents"]
_PAGE_TYPES = ["long", "double", "double", "array<double>", "double", *["array<long>"] * 3, *["array<double>"] * 2]


def pages_of(rows: DataFrame, width: int, size: int, largest: int) -> DataFrame:
    """Rows of (vec_id, v, route, distance) to pages, each with its own distances beside its leaves."""

    def make(ids, vectors, distances, route):
        page = Page.built(ids, vectors, largest)
        points = _lifted(vectors, largest)
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max())
        parts = [page.ids, page.vectors.astype(np.int64), page.leaf_sizes, page.centres, page.parents]
        return [route, float(distances.min()), float(distances.max()), centre, radius, *[p.reshape(-1) for p in parts]]

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(_PAGE, _PAGE_TYPES))
    pages = _runs(rows, width, size, make, schema, _PAGE)
    return stage(pages.withColumn("page", F.monotonically_increasing_id()), "pages")


def blocks_of(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Rows of queries to blocks (block, query_ids, queries)."""
    schema, names = "query_ids array<long>, queries array<long>", ["query_ids", "queries"]
    blocks = _runs(rows, width, size, lambda ids, vectors, *_: [ids, vectors.reshape(-1)], schema, names)
    return stage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def lower_bounds(
    points: np.ndarray, routes: np.ndarray, route: np.ndarray, low, high, centres: np.ndarray, radii
) -> np.ndarray:
    """The least distance that a row of each page can have from each query, by stored distances alone."""
    to_route = _distances(points, routes)[:, route]
    found = np.maximum(low - to_route, to_route - high)
    return np.maximum(0.0, np.maximum(found, _distances(points, centres) - radii))


def admitted(blocks: DataFrame, pages: DataFrame, routes: np.ndarray, width: int, largest: int) -> DataFrame:
    """(block, page, mean) for each page that may serve a query of a block, by the directory alone.

    ``blocks`` has (block, query_ids, queries, bounds); mean is the mean of the queries' lower bounds.
    """
    chunks = max(1, -(-pages.count() // CHUNK_PAGES))
    entry = F.struct("page", "route", "low", "high", "centre", "radius")
    directory = (
        pages.withColumn("chunk", F.pmod("page", F.lit(chunks)).cast("int"))
        .groupBy("chunk")
        .agg(F.collect_list(entry).alias("entries"))
        .select("chunk", *[F.col(f"entries.{name}").alias(name) for name in ("page", "route", "low", "high", "radius")],
                F.flatten("entries.centre").alias("centres"))
    )
    shared = blocks.sparkSession.sparkContext.broadcast(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = batch.column(0).slice(row, 1)
                queries, bounds, page, route, low, high, radius, centres = (
                    column.slice(row, 1).flatten().to_numpy() for column in batch.columns[1:]
                )
                points = queries.reshape(-1, width).astype(np.float64)
                points = np.concatenate([points, np.zeros((len(points), 1))], axis=1)
                least = lower_bounds(points, shared.value, route, low, high, centres.reshape(len(page), -1), radius)
                kept = np.flatnonzero((least <= reaches(points, bounds, largest)[:, None]).any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(kept), block[0].as_py())),
                        pa.array(page[kept]),
                        pa.array(least[:, kept].mean(axis=0)),
                    ],
                    names=["block", "page", "mean"],
                )

    pairs = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(directory, "chunk")
    columns = ["block", "queries", "bounds", "page", "route", "low", "high", "radius", "centres"]
    return in_arrow(pairs.select(*columns), run, "block long, page long, mean double")


_FOUND = "block long, bounds array<long>, query_ids array<long>, vec_ids array<long>, scores array<long>"


def searched(pairs: DataFrame, blocks: DataFrame, pages: DataFrame, width: int, k: int, largest: int) -> DataFrame:
    """Rows of (block, page) to the rows found there and the block's bounds afterwards.

    A task remembers the best scores of the blocks it last met, so what leaves it per query hardly grows with its pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, Best] = OrderedDict()
        for batch in batches:
            for row in range(len(batch)):
                block = batch.column(0)[row].as_py()
                query_ids, queries, bounds, *parts = (
                    column.slice(row, 1).flatten().to_numpy() for column in batch.columns[1:]
                )
                best = known.pop(block, None) or Best(len(query_ids), k, bounds)
                known[block] = best
                while len(known) > REMEMBERED:
                    known.popitem(last=False)
                Page(*parts, largest).search_block(queries.reshape(-1, width), query_ids, best)
                at, ids, scores = best.hits()
                columns = [pa.array([c]) for c in (best.bounds, query_ids[at], ids, scores)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), *columns], names=["block", "bounds", "query_ids", "vec_ids", "scores"]
                )

    joined = pairs.select("block", "page").join(pages, "page").join(blocks, "block")
    columns = ["block", "query_ids", "queries", "bounds", "ids", "vectors", "leaf_sizes", "centres", "parents"]
    return in_arrow(joined.select(*columns), run, _FOUND)


def _hits(found: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("hit")
    return found.select(each).select(
        F.col("hit.query_ids").alias("query_id"), F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and v, arrays of whole numbers (long) of one length; other columns are ignored. Ties go to
    the smaller vec_id; ranks run from 1. Null ids and arrays, arrays with nulls and arrays of another length than the
    most frequent one take no part. Rows that share an id are all candidates, but none of its own query's; repeated
    queries are answered once. An empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"))
    vectors = vectors.where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    sizes = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes[0] if sizes else 0
    vectors = vectors.where(F.size("v") == width)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda total, x: total + x * x)
    count, largest = vectors.agg(F.count("*"), F.max(norm)).first()
    if not count or not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with staging_scope(vectors.sparkSession):
        drawn = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()
        sample = _lifted(np.array([r.v for r in drawn], dtype=np.int64), largest)
        routes = _routes(sample, min(MAX_ROUTES, max(1, count // PAGE_ROWS)))
        placed = stage(assigned(vectors, routes, width, largest), "placed")
        pages = pages_of(placed, width, PAGE_ROWS, largest)
        one = placed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "route", "distance")).alias("one"))
        blocks = blocks_of(one.select("vec_id", "one.*"), width, QUERY_BLOCK)
        free = blocks.withColumn("bounds", F.transform("query_ids", lambda _: F.lit(NONE).cast("long")))
        nearest = admitted(free, pages, routes, width, largest)
        nearest = stage(nearest.groupBy("block").agg(F.min_by("page", F.struct("mean", "page")).alias("page")), "nearest")
        first = stage(searched(nearest, free, pages, width, k, largest), "first")
        bounded = blocks.join(first.select("block", "bounds"), "block")
        rest = admitted(bounded, pages, routes, width, largest).join(nearest, ["block", "page"], "left_anti")
        hits = _hits(first).union(_hits(searched(rest, bounded, pages, width, k, largest)))
        best = _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return stage(best, "neighbours", outer=True)
