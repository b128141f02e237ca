"""Sums over near pairs that are never formed, against brute force."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeloom.operators import nearby, spatial, stations

DAY = dt.date(2024, 1, 1)


def km(a, b):
    (y1, x1), (y2, x2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    places = [(rng.uniform(-3, 3), (179 + rng.uniform(-3, 3) + 180) % 360 - 180) for _ in range(25)]
    sites = {i: rng.choice(places) for i in range(70)}
    days = [DAY + dt.timedelta(days=i) for i in range(9)]
    daily = {(i, d): rng.choice([None, rng.uniform(0, 99)]) if rng.random() < 0.2 else rng.uniform(0, 99) for i in sites for d in days if rng.random() < 0.4}
    return sites, daily


def frames(spark, made):
    sites, daily = made
    return (
        spark.createDataFrame([(i, d, v) for (i, d), v in daily.items()], "sensor_id long, date date, pm25 double"),
        spark.createDataFrame([(i, *p) for i, p in sites.items()], "sensor_id long, lat double, lon double"),
    )


def test_differences_by_bins(monkeypatch):
    rng = np.random.default_rng(1)
    band = rng.integers(0, 3, (20, 20)).astype("int16")
    band = np.maximum(band, band.T)
    for v in (np.round(rng.uniform(0, 9, 400)), np.append(rng.uniform(0, 9, 399), np.inf)):
        at, mine = rng.integers(0, 20, 400), np.array([1, 4, 19])
        want = np.zeros(3)
        for i, j in itertools.product(range(400), range(400)):
            if at[i] in mine and i != j:
                want[band[at[i], at[j]]] += abs(v[i] - v[j])
        for size in (7, 100, 512):
            monkeypatch.setattr(nearby, "BIN", size)
            monkeypatch.setattr(nearby, "BLOCK", 300)
            np.testing.assert_allclose(nearby._differences(v, at, mine, band[mine], 3), want)


def test_pairwise_disagreement(spark, made):
    sites, daily = made
    bands, want = (10.0, 50.0, 100.0, 200.0), {}
    for (a, d), x in daily.items():
        for b in sites:
            if a < b and (b, d) in daily and km(sites[a], sites[b]) <= 200:
                band = max((i for i, low in enumerate(bands[:-1]) if km(sites[a], sites[b]) >= low), default=None)
                n = want.setdefault(None if band is None else f"{bands[band]:g}-{bands[band + 1]:g}", [0, []])
                n[0] += 1
                if x is not None and daily[b, d] is not None:
                    n[1].append(abs(x - daily[b, d]))
    got = spatial.pairwise_disagreement(*frames(spark, made), F.lit("all"), bands).collect()
    assert {r.band: r.n_pairs for r in got} == {k: n for k, (n, _) in want.items()} and None in want
    for r in got:
        assert r.mae == pytest.approx(np.mean(want[r.band][1]))


def test_pairs_are_not_formed(spark, made):
    """Neither query joins stations with the days of their neighbours."""
    daily, sites = frames(spark, made)
    for out in (spatial.pairwise_disagreement(daily, sites, F.lit("all")), stations.monitor_history(daily, sites, 150.0)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" in plan and "ASIN" not in plan.upper()


def test_monitor_history(spark, made):
    sites, daily = made
    got = stations.monitor_history(*frames(spark, made), 150.0).collect()
    assert len(got) == len(daily)
    for r in got:
        for k in (1, 2, 3):
            d = r.date - dt.timedelta(days=k)
            rows = [daily[b, d] for b in sites if b != r.sensor_id and (b, d) in daily and km(sites[r.sensor_id], sites[b]) <= 150]
            known = [v for v in rows if v is not None]
            assert r[f"pm25_own_lag{k}"] == daily.get((r.sensor_id, d))
            assert r[f"pm25_near_lag{k}"] == (pytest.approx(np.mean(known)) if known else None)
            assert k > 1 or r.n_near_lag1 == (len(known) if rows else None)
