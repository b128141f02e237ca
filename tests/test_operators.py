"""Operators against brute force on small fixtures, and properties that must hold on any data."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeloom import workflows
from hazeloom.operators import assemble, calibrate, grids, models, pixels, spatial, splits, stations, temporal
from hazeloom.operators.quantile import column_medians, exact_quantiles
from hazeloom.session import scratch_path
from hazeloom.sources import readers
from hazeloom.sources.adapters import Lake
from hazeloom.sources.store import FeatureStore
from hazeloom.streaming import streams

D = dt.date


def haversine(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(a))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exact_quantiles_with_a_hot_group(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "hot": np.concatenate([rng.normal(0, 1e3, 3000), np.zeros(500), rng.normal(0, 1e-9, 500)]),
        "same": np.full(40, -3.25),
        "one": np.array([7.0]),
        "wide": rng.uniform(-1, 1, 200) * 10.0 ** rng.integers(-8, 9, 200),
        "pressure": 101000 + 60 * rng.random(4000),
        "offset": np.full(900, 1e9 + 0.25),
        "outliers": np.concatenate([5 + 1e-7 * rng.random(2000), [-1e30, 1e30]]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("hot", float("nan")), ("one", float("inf"))]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        want = np.quantile(groups[r.g], list(probs.values()))
        assert [r[n] for n in probs] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_exact_quantiles_by_null_key_overall_and_weighted(spark):
    df = spark.createDataFrame([(None, 1.0, 3), (None, 2.0, 1), ("a", 5.0, 2)], "g string, v double, n int")
    got = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}, weight="n").collect()}
    assert got == {None: 1.0, "a": 5.0}
    assert exact_quantiles(df, [], "v", {"m": 0.5}).collect()[0].m == 2.0


def test_quantile_rows_of_a_narrow_column_stay_spread(spark):
    """Of a column within 60 of 101000, only a small part of the rows reaches the last shuffle."""
    df = spark.range(40_000).select((101000 + 60 * F.rand(3)).alias("v")).cache()
    out = exact_quantiles(df, [], "v", {"m": 0.5})
    values = np.array([r.v for r in df.collect()])
    assert out.collect()[0].m == pytest.approx(np.median(values), rel=1e-15)
    plan = out._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan and "CartesianProduct" not in plan
    ranks = np.sort(values)
    width = (values.max() - values.min()) / 4096  # a part is no wider than this
    assert ((ranks > np.median(values) - 2 * width) & (ranks < np.median(values) + 2 * width)).sum() < 100


def test_column_medians_of_many_columns(spark):
    rng = np.random.default_rng(5)
    table = rng.normal(0, 1, (500, 30)) * 10.0 ** rng.integers(-3, 4, 30)
    table[rng.random(table.shape) < 0.2] = np.nan
    table[:, 7] = np.nan
    df = spark.createDataFrame(table.tolist(), [f"c{i}" for i in range(30)])
    got = {r.column: r.median for r in column_medians(df, df.columns).collect()}
    want = {f"c{i}": np.nanmedian(table[:, i]) for i in range(30) if i != 7}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def sites(spark, n, seed, lat=(23.0, 37.0), lon=(60.0, 78.0)):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(*lat), rng.uniform(*lon)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sensor_id long, lat double, lon double")


@pytest.mark.parametrize("lat", [(23.0, 37.0), (-3.0, 3.0), (60.0, 72.0)])
def test_near_pairs(spark, lat):
    # a crowded spot beside scattered sites
    rows, _ = sites(spark, 120, 3, lat, (60.0, 66.0))
    rows += [(1000 + i, sum(lat) / 2 + i * 1e-4, 61.0 + i * 1e-4) for i in range(40)]
    df = spark.createDataFrame(rows, "sensor_id long, lat double, lon double")
    want = {
        (min(a[0], b[0]), max(a[0], b[0]))
        for a, b in itertools.combinations(rows, 2)
        if haversine(a[1], a[2], b[1], b[2]) <= 30.0
    }
    got = [(r.a, r.b) for r in spatial.near_pairs(df, "sensor_id", 30.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_snap_to_valid_near_and_far(spark):
    rows, pts = sites(spark, 60, 5)
    rng = random.Random(6)
    cells = [(rng.uniform(23, 26), rng.uniform(60, 64)) for _ in range(30)] + [(36.5, 77.0)]
    scale = math.cos(math.radians(float(np.median([c[0] for c in cells]))))
    out = spatial.snap_to_valid(pts, spark.createDataFrame(cells, "cell_lat double, cell_lon double"))
    for r in out.collect():
        want = min(cells, key=lambda c: (c[0] - r.lat) ** 2 + ((c[1] - r.lon) * scale) ** 2)
        assert (r.cell_lat, r.cell_lon) == want
        assert r.snap_dist_km == pytest.approx(haversine(r.lat, r.lon, *want))


def test_concave_polygon_with_hole(spark):
    outer = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    hole = [(2, 1), (4, 1), (4, 3), (2, 3)]
    edges = [
        (1, "land", float(a[0]), float(a[1]), float(b[0]), float(b[1]))
        for ring in (outer, hole)
        for a, b in zip(ring, ring[1:] + ring[:1])
    ]
    ed = spark.createDataFrame(edges, "poly_id int, name string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0), (3, 8.0, 5.0), (4, 8.0, 1.0), (5, -1.0, 5.0)], "sensor_id long, lat double, lon double")
    got = {r.sensor_id: r.province for r in spatial.province_join(pts, ed).collect()}
    assert got == {1: "land", 2: "Unknown", 3: "Unknown", 4: "land", 5: "Unknown"}


def test_scales_are_nested(spark, folder):
    lake = Lake(spark, folder)
    joined = pixels.pixel_window_join(lake.pixel_points(), lake.gas_pixels(), 4, 40, 40)
    out = pixels.multiscale_stats(joined, ["sensor_id", "date", "product"], [1, 2, 4])
    bad = "n_pixels_r05 > n_pixels_r1 OR n_pixels_r1 > n_pixels_r2 OR window_coverage_r2 NOT BETWEEN 0 AND 1"
    assert out.where(bad).count() == 0
    picked = pixels.best_scale(out).where("best_scale IS NOT NULL").select("sensor_id", "date", "product", "best_scale")
    full = pixels.best_scale_stats(joined, ["sensor_id", "date", "product"], [1, 2, 4])
    assert full.select(picked.columns).exceptAll(picked).count() == 0
    assert full.count() == picked.count()


def huber(x, y, eps=1.35, rounds=400):
    a, b = np.polyfit(x, y, 1)
    s = np.sqrt(np.mean((y - y.mean()) ** 2))
    for _ in range(rounds):
        r = np.abs(y - a * x - b)
        out = r > eps * s
        w = np.where(out, eps * s / np.maximum(r, 1e-12), 1.0)
        s = math.sqrt((r[~out] ** 2).sum() / max(1.0, len(x) - out.sum() * eps**2))
        det = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        a = (w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum()) / det
        b = ((w * y).sum() - a * (w * x).sum()) / w.sum()
    return a, b


def test_daily_affine_resists_outliers(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(10, 100, 80)
    y = 1.5 * x - 7 + rng.normal(0, 2, 80)
    y[:8] += 400
    rows = [(D(2024, 1, 1), float(b), float(a)) for a, b in zip(x, y)] + [(D(2024, 1, 2), 1.0, 2.0)] * 4
    df = spark.createDataFrame(rows, "date date, y_true double, y_pred double")
    fit = {r.date: r for r in calibrate.daily_affine_fit(df).collect()}
    a, b = huber(x, y)
    day = fit[D(2024, 1, 1)]
    assert (day.slope, day.intercept) == (pytest.approx(a, abs=1e-3), pytest.approx(b, abs=0.05))
    assert (fit[D(2024, 1, 2)].slope, fit[D(2024, 1, 2)].intercept) == (1.0, 0.0)


def test_busy_station_gives_the_same_windows(spark, folder):
    """A third of all readings from one station change nothing for the others and stay one row per hour."""
    lake = Lake(spark, folder)
    raw = lake.readings().select("sensor_id", "ts", "pm25")
    busy = raw.limit(500).crossJoin(spark.range(2)).select(F.lit(-1).cast("long").alias("sensor_id"), "ts", "pm25")
    plain = stations.hourly_to_daily(stations.quality_control(stations.hourly_readings(raw)))
    mixed = stations.hourly_to_daily(stations.quality_control(stations.hourly_readings(raw.unionByName(busy))))
    assert mixed.where("sensor_id >= 0").exceptAll(plain).count() == 0
    assert mixed.where("sensor_id < 0 AND n_hours_valid > 24").count() == 0


def test_segments_never_cross_gaps(spark, folder):
    seg = temporal.time_segments(Lake(spark, folder).sparse_daily())
    w = temporal.series(["sensor_id", "segment"], "date")
    assert seg.withColumn("g", temporal.days_since_previous("date", w)).where("g > 2").count() == 0


def test_history_matches_the_full_series(spark, folder):
    daily = Lake(spark, folder).met_daily()
    part = temporal.history_features(daily, "2024-01-25", "2024-01-28").where("date <= '2024-01-28'")
    names = ["sensor_id", "date", "blh_rollmean_14d", "WS10_lag3d", "calm7_count"]
    full = temporal.met_level2(daily, preset="grid").where("date BETWEEN '2024-01-25' AND '2024-01-28'")
    rounded = [F.round(c, 6).alias(c) if c.startswith(("blh", "WS")) else F.col(c) for c in names]
    assert part.select(rounded).exceptAll(full.select(rounded)).count() == 0


def test_rewriting_a_date_changes_nothing(spark):
    store = FeatureStore(spark, scratch_path(spark, "t"))
    rows = spark.createDataFrame([(1, D(2024, 1, 1), 1.0), (2, D(2024, 1, 2), 2.0)], "k int, date date, v double")
    assert store.write("s", rows) == 2
    assert store.write("s", rows.withColumn("v", F.lit(9.0))) == 0
    assert sorted(r.v for r in store.read("s").collect()) == [1.0, 2.0]
    store.write("s", rows.where("k = 2").withColumn("v", F.lit(9.0)), overwrite=True)
    assert sorted(r.v for r in store.read("s").collect()) == [1.0, 9.0]
    assert store.read("s", dates=["2024-01-02"], columns=["v", "absent"]).columns == ["v", "date"]
    assert not store.exists("other")
    plan = store.read_date("s", "2024-01-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_grid_write_reports_odd_days(spark):
    store = FeatureStore(spark, scratch_path(spark, "g"))
    rows = spark.createDataFrame([(D(2024, 1, 1), 30.0, 70.0), (D(2024, 1, 1), 30.1, 70.0), (D(2024, 1, 2), 30.0, 70.0)], "date date, lat double, lon double")
    assert [r.date for r in store.write_grid("c", rows, expected_rows=2).collect()] == [D(2024, 1, 2)]
    assert store.read("c").select("cell_id").distinct().count() == 2
    with pytest.raises(ValueError):
        store.write_grid("d", rows.drop("lat"))


def test_quality_documents_from_files(spark):
    folder = scratch_path(spark, "q")
    doc = '{"total_features": 3, "missing_features": 0, "available_features": 3, "nan_fraction": 0.1, "pakistan_cells": 5,\n "stage_coverage": {"met": 0.9}, "stage_nan_fraction": {"met": 0.1}, "stage_feature_count": {"met": 3}}'
    import os

    os.makedirs(folder)
    with open(f"{folder}/quality_2025-01-09.json", "w") as f:
        f.write(doc)
    r = assemble.flatten_quality(readers.read_quality_documents(spark, folder), ["met", "aod"]).first()
    assert (r.date, r.country_cells, r.met_coverage, r.aod_coverage) == (D(2025, 1, 9), 5, 0.9, None)


def test_folds_cover_everything_once(spark, folder):
    lake = Lake(spark, folder)
    net = lake.station_daily().join(lake.stations(), "sensor_id")
    assert splits.station_kfold(net, 4).where("fold NOT BETWEEN 0 AND 3").count() == 0
    folds = splits.spatial_block_folds(lake.stations(), 3)
    assert folds.count() == lake.stations().count()
    assert folds.groupBy("province", "block_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    train, held = splits.holdout_split(net, lake.stations().where("province = 'ASIA'"), ["sensor_id"])
    assert train.count() + held.count() == net.count()
    blocks = splits.stratified_block_split(splits.degree_blocks(net), min_val_rows=10)
    share = blocks.agg(F.sum(F.col("n") * F.col("is_val")) / F.sum("n")).first()[0]
    assert 0.18 <= share <= 0.6


def test_too_few_stations_or_years_are_an_error(spark, folder):
    lake = Lake(spark, folder)
    net = lake.station_daily().join(lake.stations(), "sensor_id")
    with pytest.raises(Exception, match="fewer than 10000 stations"):
        splits.sensor_kfold_in_province(net, "ASIA", 10_000).collect()
    with pytest.raises(Exception, match="fewer than 2 years"):
        splits.waterline_split(lake.yearly(), "1996-01-31").collect()


def test_provinces_without_squares_get_clusters(spark):
    rows = [(i, 30.0 + i * 0.3, 70.0, "wide") for i in range(8)] + [(20, 31.0, 71.0, "close"), (21, 31.0009, 71.0, "close")]
    rows += [(30, 33.0, 72.0, "lone"), (40, 25.0, 65.0, None), (41, 25.0009, 65.0, None)]
    sites = spark.createDataFrame(rows, "sensor_id long, lat double, lon double, province string")
    got = {r.sensor_id: r for r in splits.spatial_block_folds(sites, 5).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[20].block_id != got[21].block_id and {got[20].fold, got[21].fold} == {0, 1} and got[20].grid_km is None
    assert {got[40].fold, got[41].fold} == {0, 1} and got[30].fold is None and got[0].grid_km == 75.0


def test_near_pairs_across_the_date_line_and_at_the_pole(spark):
    rows = [(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 89.95, 0.0), (4, 89.95, 180.0), (5, 89.99, 90.0), (6, 60.0, 179.9), (7, 60.0, -179.9)]
    rows += [(8, -5.0, 180.0), (9, -5.0, -180.0)]
    got = spatial.near_pairs(spark.createDataFrame(rows, "sensor_id long, lat double, lon double"), "sensor_id", 30.0).collect()
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if haversine(a[1], a[2], b[1], b[2]) <= 30.0}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and {(1, 2), (3, 4), (6, 7), (8, 9)} <= want


def test_history_does_not_depend_on_the_range(spark):
    day = lambda i: D(2024, 1, 1) + dt.timedelta(days=i)
    rows = [(1, day(i), float(i % 7), 5.0 if i == 10 else None, 2.0 if i == 30 else None) for i in range(0, 46)]
    df = spark.createDataFrame(rows, "sensor_id long, date date, WS10 double, BLH_tend double, dT double")
    pick = lambda r: (r.BLH_tend, r.dT, r.WS10_rollmean_3d)
    alone = pick(temporal.history_features(df, "2024-02-15", "2024-02-15").collect()[0])
    wide = {r.date: pick(r) for r in temporal.history_features(df, "2024-01-10", "2024-02-15").collect()}
    assert wide[D(2024, 2, 15)] == alone and alone[:2] == (None, 2.0)
    assert wide[D(2024, 1, 20)][0] == 5.0 and wide[D(2024, 2, 2)][0] is None and len(wide) == 37


def test_norm_dates_are_evenly_spaced(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(137)]
    df = spark.createDataFrame(rows, "date date, v double")
    picked = np.linspace(0, 136, 50, dtype=int)
    r = grids.norm_stats(df, ["v"], n_dates=50).first()
    assert (r.n, r["mean"]) == (50, pytest.approx(float(np.mean(picked))))


def test_median_impute_falls_back(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    out = assemble.median_impute(df, ["a", "b"], None).collect()
    assert sorted(r.a for r in out) == [1.0, 2.0, 3.0] and {r.b for r in out} == {0.0}


def test_feature_coverage_keeps_all_when_few_remain(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert {r.keep for r in assemble.feature_coverage(df, ["a", "b"], keep_all_below=20).collect()} == {1}
    kept = {r.column_name: r.keep for r in assemble.feature_coverage(df, ["a", "b"]).collect()}
    assert kept == {"a": 1, "b": 0}


def test_master_is_found_below_the_root(spark):
    store = FeatureStore(spark, scratch_path(spark, "m"))
    store.write("master", spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 2, 1))], "k int, date date"))
    assert [r.k for r in store.read_master(start="2024-01-15").collect()] == [2]


def write_readings(spark, folder, rows):
    frame = spark.createDataFrame(rows, "sensor_id long, ts timestamp, pm25 double")
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_daily_stream_over_several_batches(spark):
    base = scratch_path(spark, "s")
    t = dt.datetime
    write_readings(spark, f"{base}/in", [(1, t(2024, 1, 1, h), float(h)) for h in range(24)])
    source = lambda: spark.readStream.schema("sensor_id long, ts timestamp, pm25 double").parquet(f"{base}/in")
    run = lambda: streams.run_to_table(streams.stream_hourly_to_daily(source()), f"{base}/out", f"{base}/cp")
    assert run().count() == 0
    # an hour that is late but within the watermark, then a day that closes the first one
    write_readings(spark, f"{base}/in", [(1, t(2024, 1, 1, 23, 30), 47.0)])
    write_readings(spark, f"{base}/in", [(1, t(2024, 1, 2, 12), 5.0)])
    rows = run().collect()
    assert [(r.date, r.n_hours_valid, r.complete) for r in rows] == [(D(2024, 1, 1), 24, 1)]
    assert rows[0].pm25_mean == pytest.approx((sum(range(23)) + 35.0) / 24)
    assert run().count() == 1


def test_lag_stream_remembers_across_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    base = scratch_path(spark, "l")
    t = dt.datetime
    schema = "sensor_id long, ts timestamp, pm25 double"
    run = lambda: streams.run_to_table(
        streams.stream_lag_features(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/cp"
    )
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        for rows in (
            [(1, t(2024, 1, 1), 1.0), (1, t(2024, 1, 1), 1.0), (2, t(2024, 1, 3), 5.0)],
            [(1, t(2024, 1, 2), 2.0), (1, t(2024, 1, 1), 1.0), (2, t(2024, 1, 2), 7.0)],  # resent, and before its successor
            [(1, t(2024, 1, 8), 8.0)],
            [(1, t(2024, 1, 3), 3.0)],  # late
            [(2, t(2024, 2, 20), 9.0)],  # moves the watermark past all of them
        ):
            write_readings(spark, f"{base}/in", rows)
            out = run()
        got = {(r.sensor_id, r.date): r.pm25_lag1 for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {(1, 1): None, (1, 2): 1.0, (1, 3): 2.0, (1, 8): None, (2, 2): None, (2, 3): 7.0}
    assert got == {(k, D(2024, 1, d)): v for (k, d), v in want.items()}


def test_prediction_keeps_the_rows_and_gaps(spark, folder):
    lake = Lake(spark, folder)
    rows = lake.met_daily().join(lake.station_daily(), ["sensor_id", "date"])
    fitted = models.train_gbt(rows, ["WS10", "RH"], params=models.TreeParams(rounds=2, depth=2))
    out = fitted.predict(rows)
    assert out.columns == [*rows.columns, "y_pred"]
    assert out.drop("y_pred").exceptAll(rows).count() == 0
    assert out.where("y_pred IS NULL").count() == 0


def files_by_date(store, stage):
    out = {}
    for f in store.spark.read.parquet(store.path(stage)).inputFiles():
        out.setdefault(f.split("date=")[1].split("/")[0], set()).add(f)
    return out


def test_refresh_writes_missing_dates_with_their_history(spark, folder):
    daily = Lake(spark, folder).met_daily()
    store = FeatureStore(spark, scratch_path(spark, "r"))
    whole = workflows.refresh_stage(store, "all", daily, temporal.met_level2)
    assert whole == workflows.Refreshed(30, 0, 0)
    workflows.refresh_stage(store, "met", daily.where("date < '2024-01-20'"), temporal.met_level2)
    later = workflows.refresh_stage(store, "met", daily, temporal.met_level2)
    assert later == workflows.Refreshed(11, 0, 0)
    names = ["sensor_id", "date", F.round("blh_rollmean_14d", 6).alias("b"), "WS10_lag3d", "calm7_count"]
    assert store.read("met").select(*names).exceptAll(store.read("all").select(*names)).count() == 0
    assert workflows.refresh_stage(store, "met", daily, temporal.met_level2) == workflows.Refreshed(0, 0, 0)


def test_refresh_reaches_the_dates_that_depend_on_a_change(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    rng = random.Random(4)
    values = {(s, d): rng.uniform(0, 9) for s in (1, 2, 3) for d in days if rng.random() < 0.8 or s == 3}
    frame = lambda v: spark.createDataFrame([(s, d, x) for (s, d), x in v.items()], "sensor_id long, date date, WS10 double")
    compute = lambda df: temporal.apply_specs(temporal.time_segments(df), [temporal.Lag("WS10", 3), temporal.Roll("WS10", "mean", 7)], temporal.within_segment()).drop("segment")
    store = FeatureStore(spark, scratch_path(spark, "b"))
    early = {k: x for k, x in values.items() if k[1] != days[20] and k != (2, days[30])}
    early[1, days[58]] = -1.0
    early.setdefault((2, days[45]), 3.0)
    workflows.refresh_stage(store, "s", frame(early), compute, history_rows=7)
    before = files_by_date(store, "s")

    # a whole date in the middle, a late row of one key, a correction near the end, and a row that is taken back
    values.pop((2, days[45]), None)
    got = workflows.refresh_stage(store, "s", frame(values), compute, history_rows=7)
    workflows.refresh_stage(store, "full", frame(values), compute, history_rows=7)
    same = ["sensor_id", "date", "WS10", F.round("WS10_lag3d", 9).alias("a"), F.round("WS10_rollmean_7d", 9).alias("b")]
    assert store.read("s").select(*same).exceptAll(store.read("full").select(*same)).count() == 0
    assert store.read("full").select(*same).exceptAll(store.read("s").select(*same)).count() == 0
    after = files_by_date(store, "s")
    kept = {d for d in before if after.get(d) == before[d]}
    assert got.added == 1 and got.removed == 0 and got.rewritten == len(before) - len(kept)
    assert {str(d) for d in days[:20]} <= kept and str(days[57]) in kept and str(days[44]) in kept

    # a date that is taken back altogether leaves the store
    fewer = {k: x for k, x in values.items() if k[1] != days[59]}
    assert workflows.refresh_stage(store, "s", frame(fewer), compute, history_rows=7, since="2024-02-20") == workflows.Refreshed(0, 0, 1)
    assert store.dates("s").count() == 59
    assert workflows.refresh_stage(store, "s", frame(fewer), compute, history_rows=7) == workflows.Refreshed(0, 0, 0)


def test_master_build_and_yearly_training(spark, folder):
    lake = Lake(spark, folder)
    store = FeatureStore(spark, scratch_path(spark, "w"))
    workflows.refresh_stage(store, "met", lake.met_daily(), temporal.met_level2)
    base = lake.station_daily().drop("n")
    workflows.build_master(store, base, {"met": ["WS10"]}, ["sensor_id", "date"])
    master = store.read_master()
    assert master.count() == base.count() and "WS10_lag1d" in master.columns
    rows = master.withColumn("date", F.date_add("date", (F.lit(400) * (F.col("sensor_id") % 3)).cast("int")))
    report = workflows.train_and_evaluate(
        rows, ["WS10", "RH"], [2024, 2025], [2025], [2026], models.TreeParams(rounds=2, depth=2)
    )
    assert {r.scope for r in report.metrics.collect()} == {"overall", "month", "season"}
    skill = report.skill.first()
    assert skill.mae > 0 and skill.mae_climatology > 0


def test_saved_models_predict_the_same(spark, folder):
    lake = Lake(spark, folder)
    rows = lake.met_daily().join(lake.station_daily(), ["sensor_id", "date"]).join(lake.stations(), "sensor_id")
    params = models.TreeParams(rounds=2, depth=2)
    for i, fitted in enumerate(
        [models.train_gbt(rows, ["WS10", "RH"], categories=["province"], params=params), models.train_forest(rows, ["WS10", "RH"], trees=2, depth=2)]
    ):
        path = scratch_path(spark, f"saved{i}")
        fitted.save(path)
        loaded = models.load_fitted(spark, path)
        assert loaded is not fitted and loaded.features == fitted.features
        assert loaded.predict(rows).exceptAll(fitted.predict(rows)).count() == 0


def test_sampled_parameters_and_failing_models(spark, folder):
    drawn = models.sample_params(8, seed=3)
    assert len(set(drawn)) == 8 and drawn == models.sample_params(8, seed=3)
    assert len(models.sample_params(99, {"depth": (2, 3)}, rounds=5)) == 2
    lake = Lake(spark, folder)
    rows = lake.met_daily().join(lake.station_daily(), ["sensor_id", "date"])

    def broken(_):
        raise ValueError("no such library")

    params = models.TreeParams(rounds=2, depth=2)
    good = lambda d: models.train_gbt(d, ["WS10"], params=params)
    with pytest.warns(UserWarning, match="no such library"):
        ranked = models.compare_models(rows, rows, {"broken": broken, "good": good}).collect()
    assert [r.model for r in ranked] == ["good", "broken"] and ranked[1].mae is None
