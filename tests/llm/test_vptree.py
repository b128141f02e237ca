import inspect
import math
import random

import numpy as np

from pyspark.sql import functions as F

from hazeloom.llm import vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, k=10):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in usable if i % 100 == 0}:
        near = {}
        for own in [v for i, v in usable if i == q]:
            for i, v in usable:
                if i != q and len(v) == len(own):
                    d = math.dist(own, v)
                    near[i] = min(near.get(i, math.inf), d)
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in vptree.nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    as_float = lambda x: float.fromhex(float(round(x * 256) / 256).hex())  # noqa: E731  exact in single precision
    return [(i, [as_float(rng.gauss(0, 1)) for _ in range(dim)]) for i in range(n)]


def same(got, want):
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        assert [i for _, i in near] == [i for _, i in want[q]]
        assert all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(near, want[q]))


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 150)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 3)
    rows = vectors(600, 4)
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000 + i, rows[5][1]) for i in range(30)]  # a hot vector
    same(run(spark, rows, factor=1.0), brute_force(rows))


def test_recall_of_the_default(spark):
    rows = vectors(3000, 32, seed=2)
    got, want = run(spark, rows), brute_force(rows)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert sum(hits) >= 9 * len(hits)


def test_distances_computed_and_recall():
    """Uniform directions in 64 dimensions, the hardest case: neighbours at 1.1, strangers at 1.4."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, asked = np.arange(len(v)), np.arange(0, len(v), 100)
    full = np.sqrt(np.maximum(2 - 2 * v[asked] @ v.T, 0))
    full[np.arange(len(asked)), asked] = np.inf
    want = np.argsort(full, axis=1)[:, :10]
    share, recall = {}, {}
    recall_asked = inspect.signature(vptree.nearest).parameters["recall"].default
    for factor in (1.0, vptree.calibrated(v[: vptree.SAMPLE_ROWS], 10, vptree.VANTAGES * 7, recall_asked)):
        bound = vptree.first_bounds(v[asked], asked, v[: vptree.SAMPLE_ROWS], ids[: vptree.SAMPLE_ROWS], 10)
        got = vptree.Search(v, ids, v[asked], asked, 10, factor, bound)
        share[factor] = got.compared / full.size
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.found.tolist(), want.tolist())])
    exact, default = share
    assert recall[exact] == 1.0 and recall[default] >= 0.9 and share[default] <= 0.85
    # where vectors have few dimensions in truth, exact search computes few distances
    low = np.concatenate([rng.uniform(size=(6000, 3)), np.zeros((6000, 61))], axis=1)
    full = np.sqrt(((low[asked][:, None] - low[None]) ** 2).sum(axis=2))
    full[np.arange(len(asked)), asked] = np.inf
    got = vptree.Search(low, ids, low[asked], asked, 10, 1.0)
    assert got.compared < 0.1 * full.size and (got.found == np.argsort(full, axis=1, kind="stable")[:, :10]).all()


def test_odd_rows(spark):
    rows = vectors(40, 3) + [(100, None), (200, []), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [math.nan, 1.0, 1.0])]
    rows += [(600, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (0, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5])]
    rows += rows[:3]
    same(run(spark, rows, factor=1.0), brute_force(rows))
    assert run(spark, []) == {}
    assert run(spark, [(100, [1.0])]) == {}
