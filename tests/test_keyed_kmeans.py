"""k-means of many groups together: what every clustering must satisfy, and a plain version of the same steps."""

import math
import random
from collections import Counter, defaultdict

from hazeloom.operators import keyed_kmeans, splits


def plain(points, k):
    weight = Counter(points)
    places = sorted(weight)
    centres = [min(places)]
    while len(centres) < k:
        d2, far = max((min((c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2 for c in centres), p) for p in places)
        if d2 == 0:
            break
        centres.append(far)
    while True:
        at = {p: min(range(len(centres)), key=lambda i: ((centres[i][0] - p[0]) ** 2 + (centres[i][1] - p[1]) ** 2, i)) for p in places}
        new = []
        for i in range(len(centres)):
            own = [p for p in places if at[p] == i]
            if own:
                n = sum(weight[p] for p in own)
                new.append(tuple(sum(weight[p] * p[j] for p in own) / n for j in (0, 1)))
        if len(new) == len(centres) and all(math.dist(a, b) < 1e-9 for a, b in zip(new, centres)):
            return at, len(new)
        centres = new


def made(seed):
    rng = random.Random(seed)
    rows = []
    for g, n in (("a", 200), ("b", 40), (None, 30), ("", 3)):
        middles = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(5)]
        for _ in range(n):
            m = rng.choice(middles)
            rows.append((g, round(rng.gauss(m[0], 3), 1), round(rng.gauss(m[1], 3), 1)))
    return rows + [("one", 1.0, 1.0)] * 5 + rows[:30]


def test_equals_a_plain_version(spark):
    rows = made(1)
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "g string, x double, y double")
    got = defaultdict(dict)
    counts = {}
    for r in keyed_kmeans.keyed_kmeans(df, "g", 4).collect():
        got[r.g][r.x, r.y] = r.cluster
        counts[r.g] = r.n_clusters
    assert set(got) == {"a", "b", None, "", "one"} and counts["one"] == 1 and counts[""] == 3
    for g in got:
        at, n = plain([(x, y) for h, x, y in rows if h == g], 4)
        assert counts[g] == n and got[g] == at


def test_jobs_do_not_depend_on_the_number_of_groups(spark, monkeypatch):
    written = []
    own = keyed_kmeans.stored
    monkeypatch.setattr(keyed_kmeans, "stored", lambda df, name: written.append(name) or own(df, name))
    points = [(float(i % 3) * 50 + i / 10, float(i)) for i in range(12)]
    for groups in (1, 40):
        written.clear()
        df = spark.createDataFrame([(f"g{g}", x, y) for g in range(groups) for x, y in points], "g string, x double, y double")
        assert keyed_kmeans.keyed_kmeans(df, "g", 3).count() == groups * len(points)
        assert len(written) < 12
        first = len(written) if groups == 1 else first  # noqa: F821
    assert len(written) == first


def test_provinces_without_squares_are_clustered_together(spark):
    rows = [(i, 30 + i * 1e-4, 70.0, "close") for i in range(20)] + [(100 + i, 31.0, 71.0 + i * 1e-4, None) for i in range(5)]
    rows += [(200, 25.0, 60.0, "lone"), (201, 25.0, 60.0, "lone")] + [(300 + i, 20.0 + i, 65.0, "wide") for i in range(4)]
    out = splits.grid_blocks(spark.createDataFrame(rows, "sensor_id long, lat double, lon double, province string")).collect()
    assert sorted(r.sensor_id for r in out) == sorted(r[0] for r in rows)
    by = defaultdict(set)
    for r in out:
        by[r.province].add((r.block_id, r.grid_km is None, r.n_blocks))
    assert {p: len(b) for p, b in by.items()} == {"close": 12, None: 5, "lone": 1, "wide": 4}
    assert all(none for p in ("close", None, "lone") for _, none, _ in by[p]) and not any(none for _, none, _ in by["wide"])
