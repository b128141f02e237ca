"""Hand-made edge cases of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazeloom.functions import aqi, geo, ids, met, quality, timecols
from hazeloom.operators import assemble, evaluate, grids, pixels, spatial, temporal
from hazeloom.semantics import coerce_numeric, finite, min_periods

D = dt.date


def days(spark, values, sensor=1):
    """Rows (sensor_id, date, v) from {day of January: value}."""
    rows = [(sensor, D(2024, 1, d), v) for d, v in values.items()]
    return spark.createDataFrame(rows, "sensor_id long, date date, v double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_gap_of_two_days_stays_three_splits(spark):
    out = temporal.time_segments(days(spark, {1: 1.0, 2: 2.0, 4: 3.0, 7: 4.0}))
    assert column(out, "segment") == [1, 1, 1, 2]


def test_lag_does_not_cross_a_gap(spark):
    seg = temporal.time_segments(days(spark, {1: 1.0, 2: 2.0, 4: 3.0, 7: 4.0}))
    assert column(temporal.segment_lag(seg, ["v"], [1]), "v_lag1d") == [None, 1.0, 2.0, None]


def test_min_periods_presets():
    assert [min_periods(n) for n in (3, 7, 14)] == [1, 3, 7]
    assert [min_periods(n, "grid") for n in (3, 7, 14)] == [2, 4, 7]


def test_rolling_needs_known_values(spark):
    seg = temporal.time_segments(days(spark, {1: 1.0, 2: None, 3: 3.0}))
    out = temporal.segment_rolling(seg, [temporal.Roll("v", "mean", 7)])
    assert column(out, "v_rollmean_7d") == [None, None, None]


def test_unknown_wind_is_not_calm(spark):
    df = days(spark, {1: None, 2: 1.0}).withColumnRenamed("v", "WS10")
    out = temporal.calm_counts(temporal.time_segments(df), temporal.within_segment())
    assert column(out, "calm3_count") == [0, 1]
    assert column(out, "calm3_flag") == [0, 0]


def test_target_rolls_exclude_today(spark):
    df = days(spark, {1: 1.0, 2: 2.0, 3: 9.0}).withColumnRenamed("v", "pm25")
    assert column(temporal.target_rolls(df), "pm25_rollmean_3") == [None, 1.0, 1.5]


def pixel_rows(spark, values):
    return spark.createDataFrame([(1, v) for v in values], "k int, value double")


def test_constant_window(spark):
    r = pixels.robust_window_stats(pixel_rows(spark, [5.0] * 4), ["k"]).first()
    assert (r.skew, r.kurt, r.std, r.cv, r.mad) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_two_pixels(spark):
    r = pixels.robust_window_stats(pixel_rows(spark, [1.0, 2.0]), ["k"]).first()
    assert r.skew is None and r.kurt is None
    assert (r["std"], r.p10) == (0.5, pytest.approx(1.1))


def test_no_valid_pixel(spark):
    r = pixels.robust_window_stats(pixel_rows(spark, [None, None]), ["k"]).first()
    assert r.n_pixels == 0 and r.median is None and r.mad is None


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (9,), (9,), (9,)], "q int")
    assert df.agg(quality.mode_in_range(F.col("q"), 7).alias("m")).first().m == 1


@pytest.mark.parametrize("counts, scale", [((3, 5, 40), "r1"), ((1, 2, 2), "r1"), ((0, 0, 0), None), ((9, 9, 9), "r05"), ((0, 0, 3), "r2")])
def test_best_scale(spark, counts, scale):
    df = spark.createDataFrame([counts], "n_pixels_r05 int, n_pixels_r1 int, n_pixels_r2 int")
    r = pixels.best_scale(df).first()
    assert r.best_scale == scale
    assert (r.invalid_reason == "") == (scale is not None)


def test_window_at_corner(spark):
    point = spark.createDataFrame([(1, 0, 0)], "sensor_id long, prow int, pcol int")
    assert pixels.window_offsets(point, 1, 40, 40).count() == 4


def test_progressive_window_grows_only_as_needed(spark):
    point = spark.createDataFrame([(1, 5, 5)], "sensor_id long, prow int, pcol int")
    grid = [(r, c, 1.0 if (r, c) == (5, 7) else (2.0 if (r, c) == (8, 8) else None), 0) for r in range(10) for c in range(10)]
    px = spark.createDataFrame(grid, "prow int, pcol int, od double, qa int")
    r = pixels.progressive_window(pixels.pixel_window_join(point, px, 3, 10, 10), ["sensor_id"], ["od"]).first()
    assert (r.window_size_used, r.od, r.od_n_pixels) == (5, 1.0, 1)


def test_edge_replicated_window(spark):
    grid = spark.createDataFrame([(1, r, c, float(3 * r + c)) for r in range(3) for c in range(3)], "d int, prow int, pcol int, value double")
    out = {(r.prow, r.pcol): r.value for r in pixels.grid_window_stat(grid, ["d"], 1, "mean", 3, 3).collect()}
    # corner: its own value four times, two edge neighbours twice, the diagonal once
    assert out[(0, 0)] == pytest.approx((0 * 4 + 1 * 2 + 3 * 2 + 4) / 9)
    assert out[(1, 1)] == pytest.approx(4.0)


def test_tile_edges(spark):
    r = spark.createDataFrame([(31.52, 74.3587), (91.0, 0.0)], "lat double, lon double").select(
        geo.sinusoidal_tile_pixel(F.col("lat"), F.col("lon")).alias("t")
    ).collect()
    assert 0 <= r[0].t.row < 1200 and 0 <= r[0].t.col < 1200 and (r[0].t.h, r[0].t.v) == (24, 5)
    assert r[1].t is None


@pytest.mark.parametrize("u, v, angle", [(0.0, -1.0, 0.0), (-1.0, 0.0, 90.0), (0.0, 1.0, 180.0), (1.0, 0.0, 270.0)])
def test_wind_direction(spark, u, v, angle):
    assert one(spark, met.wind_direction(F.lit(u), F.lit(v))) == pytest.approx(angle)


@pytest.mark.parametrize("c, index", [(12.05, 50.0), (501.0, None), (None, None), (0.0, 0.0), (500.4, 500.0), (35.45, 100.0)])
def test_aqi(spark, c, index):
    got = one(spark, aqi.pm25_to_aqi(F.lit(c).cast("double")))
    assert got == (None if index is None else pytest.approx(index))


@pytest.mark.parametrize("c, category", [(9.0, 0), (9.1, 1), (55.4, 2), (600.0, 5)])
def test_aqi_category_right_closed(spark, c, category):
    assert one(spark, aqi.aqi_category(F.lit(c))) == category


@pytest.mark.parametrize("y, w", [(99.0, 1.0), (100.0, 2.0), (150.0, 5.0), (250.0, 11.0)])
def test_tail_weights(spark, y, w):
    assert one(spark, aqi.tail_weights(F.lit(y))) == w


def test_persistence_gap(spark):
    df = days(spark, {1: 1.0, 3: 3.0, 4: 4.0}).withColumnRenamed("v", "pm25")
    assert column(evaluate.persistence_baseline(df, df), "persistence") == [None, None, 3.0]


def test_climatology_fallbacks(spark):
    train = spark.createDataFrame(
        [(1, D(2023, 1, 1), 10.0), (1, D(2023, 1, 2), 20.0), (2, D(2023, 1, 3), 60.0), (2, D(2023, 2, 1), 100.0)],
        "sensor_id long, date date, pm25 double",
    )
    test = spark.createDataFrame(
        [(1, D(2024, 1, 5), 0.0), (9, D(2024, 1, 6), 0.0), (9, D(2024, 7, 7), 0.0)], "sensor_id long, date date, pm25 double"
    )
    assert column(evaluate.climatology_baseline(test, train), "climatology") == [15.0, 20.0, 40.0]


def test_f1_without_extremes(spark):
    df = spark.createDataFrame([(10.0, 160.0), (20.0, 20.0)], "y_true double, y_pred double")
    assert evaluate.evaluate_predictions(df).first().f1_150 == 0.0
    assert evaluate.evaluate_predictions(df, empty_f1=None).first().f1_150 is None


def test_r2_needs_spread(spark):
    df = spark.createDataFrame([(5.0, 6.0), (5.0, 4.0)], "y_true double, y_pred double")
    r = evaluate.evaluate_predictions(df).first()
    assert r.r2 is None and r.mae == 1.0


def test_duplicate_keys_are_named(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="1"):
        assemble.require_unique(df, ["k"])
    with pytest.raises(Exception, match="duplicate key"):
        assemble.master_update(df.select("k").distinct(), df, ["k"], ["v"], ["k", "v"]).collect()


def test_nan_and_text_become_null(spark):
    assert one(spark, finite(F.lit(float("nan")))) is None
    assert one(spark, finite(F.lit(float("-inf")))) is None
    assert one(spark, coerce_numeric(F.lit("x"))) is None
    assert one(spark, coerce_numeric(F.lit("inf"))) is None
    assert one(spark, coerce_numeric(F.lit(" 2.5 "))) == 2.5


def test_ids(spark):
    assert one(spark, ids.sensor_id(F.lit(31.52), F.lit(74.3587))) == 3576838660
    assert one(spark, ids.sensor_slug(F.lit("  Lahore -- US  Embassy "), F.lit(""))) == "lahore_us_embassy"
    assert one(spark, ids.sensor_slug(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, ids.sensor_slug(F.lit("--"), lat=F.lit(1.0), lon=F.lit(2.0))) == "pt_1.0000_2.0000"


@pytest.mark.parametrize("text, day", [("2024-01-05T23:30:00-05:00", D(2024, 1, 6)), ("2024-01-05 10:00:00", D(2024, 1, 5)), ("soon", None)])
def test_time_is_utc_day(spark, text, day):
    assert one(spark, timecols.normalize_time_utc(F.lit(text))) == day


def test_qa_bits(spark):
    bits = quality.qa_bits(F.lit(0b1010_101_00_011))
    assert [one(spark, bits[n]) for n in ("qa_cloudmask", "qa_adjacency", "qa_aod")] == [3, 5, 10]


def test_forecast_takes_first_known_lead(spark):
    t = dt.datetime
    rows = [(t(2024, 1, 1, 0), 6, None), (t(2024, 1, 1, 6), 0, None), (t(2024, 1, 1, 3), 3, 7.0), (t(2023, 12, 31, 18), 12, 9.0)]
    df = spark.createDataFrame(rows, "time timestamp, step int, v double").withColumn("cell", F.lit(1))
    assert grids.unfold_valid_time(df, ["cell"], ["v"]).first().v == 7.0
    assert grids.unfold_valid_time(df, ["cell"], ["v"], "first").first().v is None
    assert grids.unfold_valid_time(df, ["cell"], ["v"], "mean").first().v == 8.0


def test_irregular_axis(spark):
    axis = spark.createDataFrame([(10.0,), (20.0,), (50.0,)], "a double")
    pts = spark.createDataFrame([(14.0,), (36.0,)], "x double")
    assert column(spatial.nearest_axis_value(pts, axis, "a", "x", "near"), "near", "x") == [10.0, 50.0]


def test_interpolation_needs_all_nodes(spark):
    ax = spatial.Axis(0.0, 1.0, 3)
    cube = spark.createDataFrame([(y, x, None if (y, x) == (2, 2) else float(y + 10 * x)) for y in range(3) for x in range(3)], "iy int, ix int, value double")
    pts = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.5, 1.5), (3, 2.0, 1.0), (4, 5.0, 0.0)], "k int, y double, x double")
    out = spatial.sample_linear(pts, cube, ["k"], [("iy", F.col("y"), ax), ("ix", F.col("x"), ax)])
    assert column(out, "value", "k") == [3.0, None, 12.0, None]


def test_corner_coverage_counts_the_window(spark):
    point = spark.createDataFrame([(0, 0)], "prow int, pcol int")
    px = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 2.0, 0.1)], "prow int, pcol int, value double, qa double")
    joined = pixels.pixel_window_join(point, px, 4, 40, 40)
    r = pixels.multiscale_stats(joined, ["prow", "pcol"], [1, 2, 4], (40, 40)).first()
    assert (r.window_coverage_r05, r.window_coverage_r1, r.qa_pass_fraction_r2) == (1 / 4, 1 / 9, 1 / 25)
