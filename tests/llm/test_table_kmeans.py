import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from hazeloom.llm import table_kmeans
from hazeloom.llm.table_kmeans import LIMIT, LONGEST

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, distance string"


def brute_force(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, v, [math.floor(max(-LIMIT, min(LIMIT, 1024 * x))) for x in v]))
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [q for _, _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((square(q, c), j) for j, c in enumerate(centroids)) for _, _, q in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [q for (_, _, q), (_, c) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    per = [sum(d for d, c in at if c == j) for j in range(len(centroids))]
    cap = lambda x: min(x, LONGEST)
    return sorted(
        (repr(i), c, cap(d), cap(per[c]), cap(sum(per)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _, _), (d, c) in zip(kept, at)
    )


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = table_kmeans.clusters(df, "vec_id", "embedding", **options)
    found = found.withColumn("digest", table_kmeans.centroid_digest(F.col("centroid")))
    return sorted((repr(r.key), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.digest) for r in found.collect())


def points(n, dims, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]


def test_equals_brute_force_with_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(table_kmeans, "BLOCK_ROWS", 37)
    rows = points(300, 64)
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + rows[:20]  # a hot vector, repeated rows
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(40)]
    assert run(spark, rows) == brute_force(rows)


def test_values_that_64_bits_do_not_hold(spark):
    rows = points(60, 3, seed=2, spread=1e6) + [(100, [1e300, -1e300, 0.0]), (101, [3e8, 3e8, 3e8]), (102, [1.7e308, 0.0, 0.0])]
    assert run(spark, rows, dims=3, k=4) == brute_force(rows, dims=3, k=4)


def test_odd_rows(spark):
    rows = points(5, 4, seed=3)
    rows += [(None, [0.5] * 4), (None, [0.5] * 4), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0]), (10, [math.nan, 0.0, 0.0, 0.0])]
    rows += [(11, [math.inf, 0.0, 0.0, 0.0]), (12, [1.0, 2.0]), (13, [0.0] * 4), (13, [1.0] * 4), (14, [-0.0] * 4)]
    for k in (3, 8, 20):
        assert run(spark, rows, dims=4, k=k) == brute_force(rows, dims=4, k=k)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    rows = points(90, 5, seed=4)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts)
    got = table_kmeans.clusters(df, "vec_id", "embedding", dims=5).select("key", "cluster", "distance").collect()
    whole = table_kmeans.clusters(df.coalesce(1), "vec_id", "embedding", dims=5).select("key", "cluster", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(got) == 90


def test_a_block_tabulates_only_what_occurs():
    import numpy as np

    block = table_kmeans.Block.of(np.array([[5, -3], [5, 10**9], [7, -3]]))
    table = block.table([[5, 0], [0, 0]])
    assert block.values.tolist() == [5, 7, -3, 10**9] and table.shape == (4, 2)
    assert table[:, 0].tolist() == [0, 4, 9, 10**18]
