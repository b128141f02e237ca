"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are turned into integers once and stored in blocks of bounded size. A block holds, for every dimension, the
integers that occur in it (sorted) and a code per vector and dimension. A round tabulates the squared difference of
each dimension, occurring integer and centroid; a vector's distances are then gathered from the table by its codes and
added up over the dimensions. The table is no larger than the block, whatever the values are.

A round sends the counts and component sums of its centroids from each task, never vectors; sums are Python integers
or decimals throughout, so centroids are exact and do not depend on the partitions. The blocks are a table in the
shared folder, so a lost executor costs its tasks' blocks of the current round and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
#: Vectors in a block: with 64 dimensions and 8 centroids its table has at most 16 million numbers, mostly far fewer.
BLOCK_ROWS = 4096
#: Integers beyond this count as this, which a distance in 64 bits could not hold anyway.
LIMIT = 2**40
LONGEST = 2**63 - 1


def as_integers(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


class Block:
    """Codes (rows, dims) into ``values``, the occurring integers of dimension d at starts[d] : starts[d + 1]."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, starts: np.ndarray):
        self.codes, self.values, self.starts = codes, values, starts
        self.dimension = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        codes, values, starts = np.empty(vectors.shape, np.int32), [], [0]
        for d, column in enumerate(vectors.T):
            found, at = np.unique(column, return_inverse=True)
            codes[:, d] = at + starts[-1]
            values.append(found)
            starts.append(starts[-1] + len(found))
        return cls(codes, np.concatenate(values), np.array(starts, np.int32))

    def table(self, centroids: list[list[int]]) -> np.ndarray:
        """Squared differences as (occurring integer, centroid); Python integers where 64 bits could overflow."""
        c = np.array(centroids, np.int64).T[self.dimension]
        gap = self.values[:, None] - c
        worst = np.maximum.reduceat(np.abs(gap).max(axis=1), self.starts[:-1]).tolist()
        return (gap if sum(g * g for g in worst) <= LONGEST else gap.astype(object)) ** 2

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equals) and the squared distance, per vector."""
        table = self.table(centroids)
        total = table[self.codes[:, 0]]
        for d in range(1, self.codes.shape[1]):
            total += table[self.codes[:, d]]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Component sums (k, dims) of the vectors of each cluster."""
        out = np.zeros((k, self.codes.shape[1]), np.int64)
        order = np.argsort(cluster, kind="stable")
        used, at = np.unique(cluster[order], return_index=True)
        out[used] = np.add.reduceat(self.values[self.codes[order]], at, axis=0)
        return out


def _usable(vector: Column, dims: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~odd, F.lit(False))


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ids", "codes", "values", "starts"]

        def block(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
            b = Block.of(as_integers(vectors))
            parts = [x.tobytes() for x in (b.codes, b.values, b.starts)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([lists, *[pa.array([p], pa.binary()) for p in parts]], names)

        held_ids, held, n = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                held_ids.append(part.column("id"))
                held.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n += len(part)
                if n >= BLOCK_ROWS:
                    yield block(pa.concat_arrays(held_ids), np.concatenate(held))
                    held_ids, held, n = [], [], 0
        if n:
            yield block(pa.concat_arrays(held_ids), np.concatenate(held))

    return rows.mapInArrow(run, "ids array<bigint>, codes binary, values binary, starts binary")


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Block]]:
    parts = zip(*(batch.column(c).to_pylist() for c in ("codes", "values", "starts")))
    for ids, (codes, values, starts) in zip(batch.column("ids"), parts):
        codes = np.frombuffer(codes, np.int32).reshape(-1, dims)
        yield ids.values, Block(codes, np.frombuffer(values, np.int64), np.frombuffer(starts, np.int32))


def _totals(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[tuple[int, int, list[int]]]:
    """(count, summed distance, component sums) of every centroid's vectors: k rows on the driver."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, distance, sums = [0] * k, [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            for _, block in _read(batch, dims):
                cluster, d = block.nearest(centroids)
                sums += block.sums(cluster, k)
                for c in np.unique(cluster).tolist():
                    counts[c] += int((cluster == c).sum())
                    distance[c] += sum(d[cluster == c].tolist())
        exact = pa.decimal128(38, 0)
        rows = [[Decimal(x) for x in [counts[c], distance[c], *sums[c]]] for c in range(k) if counts[c]]
        numbers = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(rows, pa.list_(exact))], ["c", "total"])

    found = blocks.mapInArrow(run, "c int, total array<decimal(38,0)>")
    found = found.groupBy("c").agg(*[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims + 2)])
    out: list[tuple[int, int, list[int]]] = [(0, 0, [0] * dims)] * k
    for c, count, distance, *sums in found.collect():
        out[c] = int(count), int(distance), [int(s) for s in sums]
    return out


def clusters(df: DataFrame, key: str, vector: str, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3:") -> DataFrame:
    """Rows (key, cluster, distance, cluster_inertia, inertia, centroid), one for every usable vector of ``df``.

    Usable vectors have ``dims`` components, none null or non-finite; component x becomes floor(1024 * x). The first
    centroids are the ``k`` vectors with the smallest sha256 of the salt and the key, in that order; each round assigns
    every vector to its nearest centroid (squared distance, ties to the smaller number) and replaces every centroid
    with vectors by the floor of their mean. ``centroid`` is array<bigint>, the vector's own after the last round.

    Repeated rows and keys are vectors of their own; among equal keys the smaller vector comes first. A null key takes
    part, and starts a centroid only where fewer than ``k`` vectors have a key. With fewer than ``k`` vectors there are
    as many centroids as vectors, an empty table gives no rows. Integers beyond 2^40 count as 2^40, and distances and
    sums that 64 bits cannot hold as 2^63 - 1. Other columns of ``df`` do not matter.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(_usable(F.col("v"), dims))
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    centroids = [as_integers(np.array(r.v)).tolist() for r in first.collect()]
    names = ["key", "cluster", "distance"]
    schema = "key bigint, cluster int, distance bigint"
    extra = ", cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not centroids:
        return df.sparkSession.createDataFrame([], schema + extra)
    blocks = stored(_blocks(rows, dims), "blocks")
    for _ in range(rounds):
        totals = _totals(blocks, centroids, dims)
        centroids = [[s // n for s in sums] if n else old for old, (n, _, sums) in zip(centroids, totals)]
    inertia = [d for _, d, _ in _totals(blocks, centroids, dims)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _read(batch, dims):
                cluster, d = block.nearest(centroids)
                if d.dtype == object:
                    d = np.array([min(x, LONGEST) for x in d.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d)], names)

    per = F.array(*[F.lit(min(d, LONGEST)).cast("long") for d in inertia])
    middle = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in centroids])
    return blocks.mapInArrow(assign, schema).select(
        *names,
        per[F.col("cluster")].alias("cluster_inertia"),
        F.lit(min(sum(inertia), LONGEST)).cast("long").alias("inertia"),
        middle[F.col("cluster")].alias("centroid"),
    )


def centroid_digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

