"""Nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to shards of some hundred thousand by a hash of their id, queries to blocks of bounded size, and
every block meets every shard. Before that a query is compared with a bounded sample, which gives an upper bound for
its k-th distance; it travels with the query and prunes from the first node on.

A node has several vantage points, chosen for the spread of their distances: the first splits the node at the median,
and of all of them each row below keeps its distances. A side of a node is skipped for a query if the triangle
inequality, relaxed by ``factor``, rules it out: |d - mu| > factor * bound. In a leaf it is applied once more to every
row and all vantage points above it, |d(query, v) - d(row, v)| > factor * bound, and only the rows left are compared.
Where a vantage point is itself within the bound the inequality stays unrelaxed. Factor one is exact.

Of equal vectors only the k + 1 smallest ids go on, since no query can return others; so a vector that fills a third
of the table is a handful of rows, cut down in each task before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAF = 64
VANTAGES = 3
#: Points tried for a vantage point, and rows that their spread is measured on.
TRIED, MEASURED = 8, 128
SHARD_ROWS = 131_072
BLOCK_ROWS = 4096
#: Vectors that give every query its first bound.
SAMPLE_ROWS = 1024


class VPTree:
    """``path`` has the distances of a leaf's rows to the vantage points above, one line for each, in order."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray | None = None, seed: int = 1, path: list[np.ndarray] | None = None):
        self.rows, self.inner, self.outer = np.arange(len(vectors)) if rows is None else rows, None, None
        path = path or []
        if len(self.rows) > LEAF:
            own = vectors[self.rows]
            points = self._vantages(own, np.random.default_rng(seed))
            d = [np.sqrt(((own - p) ** 2).sum(axis=1)) for p in points]
            radius = float(np.median(d[0]))
            inside = d[0] <= radius
            if not inside.all():  # else more than half of them are at one distance: no way to split by it
                self.points, self.radius = points, radius
                below = lambda side: [x[side] for x in [*path, *d]]
                self.inner = VPTree(vectors, self.rows[inside], 2 * seed, below(inside))
                self.outer = VPTree(vectors, self.rows[~inside], 2 * seed + 1, below(~inside))
                self.rows = self.rows[:0]
                return
        self.path = np.array(path).reshape(len(path), len(self.rows))

    @staticmethod
    def _vantages(own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        tried, measured = own[rng.integers(len(own), size=TRIED)], own[rng.integers(len(own), size=MEASURED)]
        spread = np.sqrt(((tried[:, None] - measured[None]) ** 2).sum(axis=2)).std(axis=1)
        return tried[np.argsort(-spread, kind="stable")[:VANTAGES]]


class Search:
    """The k nearest for a block of queries in one tree, kept sorted by (distance, id).

    ``bound`` is an upper bound of each query's k-th distance; ``compared`` counts the distances computed.
    """

    def __init__(self, vectors, ids, queries, own, k: int, factor: float, bound=None):
        self.vectors, self.ids, self.queries, self.own, self.k, self.factor = vectors, ids, queries, own, k, factor
        self.score = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.bound = np.full(len(queries), np.inf) if bound is None else bound
        self.compared = 0
        self.visit(VPTree(vectors), np.arange(len(queries)), np.empty((0, len(queries))))

    def reach(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.bound[rows], self.score[rows, -1])

    def may_hold(self, own: np.ndarray, other: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether rows at distance ``other`` from a vantage point may lie within reach of queries at distance ``own``.

        With either of them within reach of the vantage point itself the inequality is nearly an equation, and
        relaxing it would lose true neighbours; there it stays as it is.
        """
        gap = np.abs(own - other)
        return (gap <= self.factor * reach + 1e-12) | ((np.minimum(own, other) <= reach) & (gap <= reach + 1e-12))

    def visit(self, node: VPTree, rows: np.ndarray, path: np.ndarray) -> None:
        """``path`` has the distances of the queries ``rows`` to the vantage points above the node."""
        if not len(rows):
            return
        if node.inner is None:
            for at in range(0, len(rows), 128):
                for c in range(0, len(node.rows), 4 * LEAF):
                    self.compare(rows[at : at + 128], path[:, at : at + 128], node.rows[c : c + 4 * LEAF], node.path[:, c : c + 4 * LEAF])
            return
        d = np.sqrt(((self.queries[rows][None] - node.points[:, None]) ** 2).sum(axis=2))
        self.compared += d.size
        path, inside = np.concatenate([path, d]), d[0] <= node.radius
        # each side once, with all queries that may find something there, so that nodes are few and blocks large
        for side, own in ((node.inner, inside), (node.outer, ~inside)):
            at = own | self.may_hold(d[0], node.radius, self.reach(rows))
            self.visit(side, rows[at], path[:, at])

    def compare(self, rows: np.ndarray, path: np.ndarray, others: np.ndarray, theirs: np.ndarray) -> None:
        near = np.ones((len(rows), len(others)), bool)
        reach = self.reach(rows)[:, None]
        for own, other in zip(path, theirs):
            near &= self.may_hold(own[:, None], other[None], reach)
        near &= self.own[rows][:, None] != self.ids[others][None]
        q, x = np.nonzero(near)
        self.compared += len(q)
        gap = self.queries[rows[q]] - self.vectors[others[x]]
        d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        better = d <= np.minimum(self.bound, self.score[:, -1])[rows[q]]
        q, x, d = q[better], x[better], d[better]
        if not len(q):
            return
        # the few that may enter, side by side with what their queries have
        asked, start, many = np.unique(q, return_index=True, return_counts=True)
        score = np.full((len(asked), self.k + int(many.max())), np.inf)
        found = np.full(score.shape, np.iinfo(np.int64).max)
        at = np.repeat(np.arange(len(asked)), many), self.k + np.arange(len(q)) - np.repeat(start, many)
        score[:, : self.k], found[:, : self.k] = self.score[rows[asked]], self.found[rows[asked]]
        score[at], found[at] = d, self.ids[others[x]]
        order = np.lexsort((found, score), axis=-1)[:, : self.k]
        self.score[rows[asked]] = np.take_along_axis(score, order, axis=1)
        self.found[rows[asked]] = np.take_along_axis(found, order, axis=1)


def first_bounds(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the k-th distances: those to the k-th of the sample's other ids (each id stands there once)."""
    if len(sample) <= k:
        return np.full(len(queries), np.inf)
    out = []
    for at in range(0, len(queries), 64):
        gap = queries[at : at + 64, None, :] - sample[None]
        d = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        d[own[at : at + 64][:, None] == ids[None]] = np.inf
        out.append(np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-12))  # sums of another order differ in the last bits
    return np.concatenate(out)


def calibrated(sample: np.ndarray, k: int, vantages: int, recall: float) -> float:
    """The factor with which the given share of near pairs of the sample survives so many vantage points; at most 1."""
    if len(sample) <= k + vantages:
        return 1.0
    rng = np.random.default_rng(len(sample))
    asked = sample[rng.permutation(len(sample))[:256]]
    points = sample[rng.permutation(len(sample))[:vantages]]
    apart = lambda a, b: np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))
    d, to_points, of_asked = apart(asked, sample), apart(sample, points), apart(asked, points)
    near = np.argsort(d, axis=1)[:, 1 : k + 1]
    bound = np.take_along_axis(d, near[:, -1:], axis=1)[:, :, None]
    own, other = of_asked[:, None, :], to_points[near]
    gap = np.where(np.minimum(own, other) > bound, np.abs(own - other), 0)
    share = (gap / np.maximum(bound, 1e-300)).max(axis=2)
    return float(min(1.0, np.quantile(share, recall)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, factor: float | None = None, recall: float = 0.97
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest other ids found for each query row, nearest first.

    Without a ``factor`` the sample sets it, for every length of vectors, so that ``recall`` of its near pairs would
    survive as many vantage points as a path down a shard's tree has; factor one is exact.

    Distance is Euclidean in double precision, ties go to the smaller id, and a query has fewer rows only where
    there are fewer candidates. Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component take no part. Vectors of another length than the query's are no candidates. Repeated rows
    count once; an id with several vectors is as near as its nearest one, as a query and as a candidate.
    """
    v = F.col(vector).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = (
        df.where(is_query.isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
        .where(~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    )
    rows = stored(rows.distinct(), "vectors")
    n, queries = rows.agg(F.count("*"), F.count_if("q")).first()
    shards = -(-n // SHARD_ROWS) or 1
    blocks = max(-(-queries // BLOCK_ROWS), min(8, -(-queries // 64))) or 1  # a small table is searched by several tasks, too
    to_all = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = lambda size: F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")

    # at most SAMPLE_ROWS vectors come to the driver and go to the tasks
    picked = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    samples: dict[int, tuple[list, list]] = {}
    for r in picked:
        ids, vectors = samples.setdefault(len(r.v), ([], []))
        ids.append(r.id)
        vectors.append(r.v)
    samples = {dim: (np.array(vectors), np.array(ids, np.int64)) for dim, (ids, vectors) in samples.items()}
    depth = max(1, math.ceil(math.log2(max(n / shards / LEAF, 2))))
    factors = {dim: calibrated(v, k, VANTAGES * depth, recall) if factor is None else factor for dim, (v, _) in samples.items()}
    exact = 1.0 if factor is None else factor  # for lengths of vectors that are not in the sample

    def bounded(batches):
        for batch in batches:
            if not len(batch):
                continue
            dims, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "id"))
            bound = np.full(len(batch), np.inf)
            for dim in np.unique(dims).tolist():
                if dim in samples:
                    at = np.flatnonzero(dims == dim)
                    asked = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    bound[at] = first_bounds(asked, own[at], *samples[dim], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "bound"])

    same = Window.partitionBy("v").orderBy("id")
    fit = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    fit = fit.select("id", "v", F.size("v").alias("dim"), dealt(shards).alias("shard"), to_all(blocks).alias("block"))
    ask = rows.where("q").select("id", "v", F.size("v").alias("dim"), dealt(blocks).alias("block"))
    ask = ask.mapInArrow(bounded, "id bigint, v array<double>, dim int, block int, bound double")
    ask = ask.select("*", to_all(shards).alias("shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = right.column("id").to_numpy()
        asked, bound = _matrix(right.column("v")), right.column("bound").to_numpy()
        own_factor = factors.get(asked.shape[1], exact)
        got = Search(_matrix(left.column("v")), left.column("id").to_numpy(), asked, own, k, own_factor, bound)
        real = np.isfinite(got.score)
        return pa.table(
            {"query_id": np.repeat(own, k).reshape(real.shape)[real], "vec_id": got.found[real], "score": got.score[real]}
        )

    on = ["dim", "shard", "block"]
    found = fit.groupBy(*on).cogroup(ask.groupBy(*on)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
