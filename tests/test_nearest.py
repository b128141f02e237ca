"""Nearest valid cell by the bucket tree, against all distances."""

import math
import random
import statistics

import pytest

from hazeloom.operators import nearest, spatial


def brute_force(points, cells):
    cells = {c for c in cells if None not in c and not any(map(math.isnan, c))}
    if not cells:
        return {}
    scale = max(math.cos(math.radians(statistics.median(c[0] for c in cells))), 1e-3)
    best = {}
    for i, y, x in points:
        if y is not None and x is not None and not math.isnan(y + x):
            best[i] = min((round((c[0] - y) ** 2 + ((c[1] - x) * scale) ** 2, 12), *c) for c in cells)[1:]
    return best


def run(spark, points, cells):
    pts = spark.createDataFrame([(*p, "x") for p in points], "sensor_id long, lat double, lon double, u string")
    out = spatial.snap_to_valid(pts, spark.createDataFrame(cells, "cell_lat double, cell_lon double")).collect()
    assert len(out) == len(points)
    return {r.sensor_id: (r.cell_lat, r.cell_lon) for r in out if r.cell_lat is not None}


@pytest.mark.parametrize("n,leaf", [(3, 32), (700, 32), (700, 4)])
def test_clusters_gaps_and_far_points(spark, monkeypatch, n, leaf):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = random.Random(n + leaf)
    cells = [(rng.gauss(30, 0.05), rng.gauss(70, 0.05)) for _ in range(n // 2)] + [(rng.uniform(-80, 80), rng.uniform(-179, 179)) for _ in range(n // 4 + 1)]
    cells += [(25 + 0.1 * (i // 20), 60 + 0.1 * (i % 20)) for i in range(n // 4)]
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(150)] + [(200 + i, rng.gauss(30, 0.2), rng.gauss(70, 0.2)) for i in range(150)]
    points += [(400 + i, 25.05 + 0.1 * (i // 10), 60.05 + 0.1 * (i % 10)) for i in range(60)]  # ties in the middle of four cells
    points += [(500 + i, *rng.choice(cells)) for i in range(20)]
    assert run(spark, points, cells) == brute_force(points, cells)


def test_odd_rows(spark):
    points = [(1, None, 1.0), (2, math.nan, 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0), (4, 1.0, 1.0)]
    assert run(spark, points, []) == {}
    assert run(spark, points, [(None, 1.0), (math.nan, 2.0)]) == {}
    assert run(spark, points, [(5.0, 5.0)] * 50 + [(None, 0.0)]) == {3: (5.0, 5.0), 4: (5.0, 5.0)}
    assert run(spark, [], [(5.0, 5.0)]) == {}


def test_far_points_meet_few_cells(spark):
    cells = [(25 + 0.1 * i, 60 + 0.1 * j) for i in range(60) for j in range(60)]
    df = spark.createDataFrame(cells, "cell_lat double, cell_lon double").selectExpr("*", "cell_lat AS y", "cell_lon AS x")
    squares, leaves = nearest._tree(df, 5, (25.0, 60.0), 5.9)
    sizes = [r["count"] for r in leaves.groupBy("depth", "u", "v").count().collect()]
    assert sum(sizes) == len(cells) and max(sizes) <= nearest.LEAF
    assert squares.where("depth = 0").first().n == len(cells)
    far = spark.createDataFrame([(-40.0, -100.0)], "_y double, _x double")
    plan = nearest.nearest_cells(far, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
