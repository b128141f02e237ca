"""Cell cover of polygons and the polygon joins, against one ray through all edges."""

import math
import random

import pytest

from hazeloom.operators import cells, spatial

EDGES = "poly_id int, name string, x1 double, y1 double, x2 double, y2 double"


def ring(points):
    return list(zip(points, points[1:] + points[:1]))


def rows(poly_id, name, *rings):
    return [(poly_id, name, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for r in rings for a, b in ring(r)]


def crossed(edges, x, y):
    hit = 0
    for _, _, x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            hit += 1
    return hit % 2 == 1


def star(rng, cx, cy, size, corners):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(cx + rng.uniform(0.2, 1) * size * math.cos(a), cy + rng.uniform(0.2, 1) * size * math.sin(a)) for a in angles]


def polygons(seed):
    rng = random.Random(seed)
    out = [
        # on cell borders, with a notch whose sides are level and upright
        rows(1, "notch", [(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (2, 1), (2, 3), (0, 3)]),
        # a hole, and an island in the hole
        rows(2, "ring", star(rng, 6, 6, 4, 40), [(5.5, 5.5), (6.5, 5.5), (6.5, 6.5), (5.5, 6.5)], [(5.9, 5.9), (6.1, 5.9), (6.1, 6.1)]),
        rows(3, "smallest", [(2.03, 2.03), (2.06, 2.03), (2.05, 2.07)]),
        rows(4, "long", [(-60, 10.01), (60, 10.3), (60, 10.31), (-60, 10.02)]),
        rows(5, "wide", [(-70, -20), (70, -21), (65, -3), (-66, -2)]),
    ]
    out += [rows(10 + i, f"star{i}", star(rng, rng.uniform(-3, 9), rng.uniform(-3, 9), rng.uniform(0.05, 5), rng.randint(3, 60))) for i in range(8)]
    return out


def points(seed, edges):
    rng = random.Random(seed)
    at = [(rng.uniform(-75, 75), rng.uniform(-22, 12)) for _ in range(300)] + [(rng.uniform(-4, 11), rng.uniform(-4, 11)) for _ in range(1500)]
    at += [(rng.randint(-40, 90) / 8, rng.randint(-40, 90) / 8) for _ in range(300)]  # corners of cells
    for _, _, x1, y1, x2, y2 in rng.sample(edges, 60):  # on corners and edges
        at += [(x1, y1), ((x1 + x2) / 2, (y1 + y2) / 2), (x1, (y1 + y2) / 2)]
    return at


@pytest.mark.parametrize("seed", [1, 2])
def test_every_polygon_of_every_point(spark, seed):
    made = polygons(seed)
    edges = [e for p in made for e in p]
    at = points(seed, edges)
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)], "i int, lat double, lon double")
    random.Random(seed).shuffle(edges)
    got = sorted((r.i, r.poly_id) for r in spatial.point_in_polygon(df, spark.createDataFrame(edges, EDGES), "i").collect())
    assert got == sorted((i, p[0][0]) for p in made for i, (x, y) in enumerate(at) if crossed(p, x, y))


def test_overlaps_shared_places_and_missing_coordinates(spark):
    edges = rows(7, "low", [(0, 0), (2, 0), (2, 2), (0, 2)]) + rows(9, "high", [(1, 1), (3, 1), (3, 3), (1, 3)])
    at = [(1, 1.5, 1.5), (2, 2.5, 2.5), (2, 2.5, 2.5), (3, 1.5, 1.5), (4, None, 1.0), (5, math.nan, 1.0), (6, 9.0, 9.0), (7, -0.0, 0.0), (None, 0.5, 0.5)]
    df = spark.createDataFrame([(*r, "x") for r in at], "sensor_id long, lat double, lon double, name string")
    ed = spark.createDataFrame([*edges, (8, "broken", None, 0.0, 5.0, 5.0)], EDGES)
    got = sorted(((r.sensor_id, r.province) for r in spatial.province_join(df, ed).collect()), key=repr)
    want = [(1, "low"), (2, "high"), (2, "high"), (3, "low"), (4, "Unknown"), (5, "Unknown"), (6, "Unknown"), (7, "low"), (None, "low")]
    assert got == sorted(want, key=repr)
    assert {r.sensor_id: r.inside for r in spatial.country_mask(df, ed).collect()} == {i: p != "Unknown" for i, p in want}
    none = spark.createDataFrame([], EDGES)
    assert [r.province for r in spatial.province_join(df, none).collect()] == ["Unknown"] * len(at)


def test_inside_cells_are_wide_and_border_cells_keep_their_own_edges(spark):
    edges = rows(1, "box", [(0.05, 0.05), (40.02, 0.05), (40.02, 20.01), (0.05, 20.01)])
    cover = cells.polygon_cover(spark.createDataFrame(edges, EDGES)).collect()
    inside = [r for r in cover if r.level != cells.BORDER]
    border = [r for r in cover if r.level == cells.BORDER]
    area = sum(2**r.level for r in inside)
    assert area == 159 * 319 and len(inside) < area / 20
    assert max(len(r.edges) for r in border) == 2 and all(not r.edges for r in inside)


def test_plan_joins_on_cells(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "sensor_id long, lat double, lon double")
    ed = spark.createDataFrame(rows(1, "a", [(0, 0), (2, 0), (1, 2)]), EDGES)
    plan = spatial.point_in_polygon(df, ed, "sensor_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and any("row" in line and "level" in line and "cell" in line for line in plan.splitlines() if "Join" in line)
