"""Summed-area tables against the cells of each window."""

import math
import random

import pytest

from hazeloom.operators import pixels, summed


def raster(spark, height, width, seed, keys=("a", None)):
    rng = random.Random(seed)
    cells = {}
    for k in keys:
        for i in range(height):
            for j in range(width):
                if rng.random() < 0.8:
                    cells[k, i, j] = None if rng.random() < 0.1 else rng.uniform(-5, 50)
    rows = [(k, i, j, v) for (k, i, j), v in cells.items()]
    rows += [("a", -1, 0, 9.0), ("a", 0, width, 9.0)]  # outside
    return cells, spark.createDataFrame(rows, "k string, prow int, pcol int, value double")


def window(cells, k, i, j, r, height, width, replicate):
    at = [(a, b) for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1)]
    if replicate:
        at = [(min(max(a, 0), height - 1), min(max(b, 0), width - 1)) for a, b in at]
    return [v for a, b in at if (v := cells.get((k, a, b))) is not None]


@pytest.mark.parametrize("block", [64, 4])
@pytest.mark.parametrize("radius", [0, 1, 3, 20])
@pytest.mark.parametrize("replicate", [True, False])
def test_windows_of_any_radius(spark, monkeypatch, block, radius, replicate):
    monkeypatch.setattr(summed, "BLOCK", block)
    height, width = 9, 13
    cells, df = raster(spark, height, width, 3)
    table = summed.summed_area(df, ["k"], height, width)
    inside = df.where(f"prow BETWEEN 0 AND {height - 1} AND pcol BETWEEN 0 AND {width - 1}")
    out = summed.window_sums(table, inside, ["k"], radius, height, width, replicate).collect()
    assert {(r.k, r.prow, r.pcol) for r in out} == set(cells)
    for r in out:
        want = window(cells, r.k, r.prow, r.pcol, radius, height, width, replicate)
        assert r.n == len(want)
        assert r.total is None if not want else r.total == pytest.approx(sum(want), abs=1e-7)


def test_grid_window_stat_by_table_and_by_cells(spark):
    height, width = 7, 5
    cells, df = raster(spark, height, width, 5, keys=("a", "b"))
    df = df.where(f"prow BETWEEN 0 AND {height - 1} AND pcol BETWEEN 0 AND {width - 1}")
    for stat, of in (("mean", lambda v: sum(v) / len(v)), ("sum", sum), ("max", max), ("min", min)):
        out = pixels.grid_window_stat(df, ["k"], 2, stat, height, width).collect()
        assert len(out) == len(cells)
        for r in out:
            want = window(cells, r.k, r.prow, r.pcol, 2, height, width, True)
            assert r.value is None if not want else r.value == pytest.approx(of(want))
    counts = {(r.k, r.prow, r.pcol): r.value for r in pixels.grid_window_stat(df, ["k"], 2, "count", height, width).collect()}
    assert all(n == len(window(cells, k, i, j, 2, height, width, True)) for (k, i, j), n in counts.items())


def test_rows_do_not_depend_on_the_radius(spark):
    _, df = raster(spark, 12, 12, 7, keys=("a",))
    table = summed.summed_area(df, ["k"], 12, 12)
    for radius in (1, 5):
        plan = summed.window_sums(table, df, ["k"], radius, 12, 12)
        assert "Cartesian" not in plan._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count() <= 12 * 12
    one = spark.createDataFrame([("a", 6, 6)], "k string, prow int, pcol int")
    r = summed.window_sums(table, one, ["k"], 2, 12, 12).first()
    assert r.n <= 25
    odd = spark.createDataFrame([("a", 0, 0, math.nan), ("a", 1, 1, math.inf), ("a", 1, 1, 2.0), ("a", 1, 1, 3.0)], "k string, prow int, pcol int, value double")
    r = summed.window_sums(summed.summed_area(odd, ["k"], 3, 3), odd.where("prow = 0"), ["k"], 1, 3, 3).first()
    assert (r.total, r.n) == (5.0, 2)
    assert summed.summed_area(odd.where("false"), ["k"], 3, 3).count() == 0
