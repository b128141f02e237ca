"""Backtests and block evaluation: folds, sizes and metrics worked out again from the rows and stored predictions."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hazeloom.operators import backtest
from hazeloom.operators.models import TreeParams

TINY = TreeParams(rounds=2, depth=2, step=0.5)


def made(spark, years=3, stations=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for s in range(stations):
        for i in range(0, 365 * years, rng.randint(2, 6)):
            d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            x = rng.uniform(0, 10)
            y = None if rng.random() < 0.05 else 20 + 3 * x + s + rng.gauss(0, 1)
            rows.append((s, d, y, None if rng.random() < 0.1 else x, "n" if s < 4 else "p" if s < 5 else None))
    return rows, spark.createDataFrame(rows, "sensor_id long, date date, pm25 double, x double, province string")


def test_monthly_backtest(spark):
    rows, df = made(spark)
    metrics, predictions = backtest.monthly_backtest(df, ["x"], "2021-11-01", "2022-12-01", params=TINY)
    stored = predictions.collect()
    got = {r.reference_date: r for r in metrics.collect()}
    assert len(got) == 14
    known = [r for r in rows if r[2] is not None]
    value = {(s, d): y for s, d, y, _, _ in known}
    for name, r in got.items():
        ref = dt.date.fromisoformat(name)
        waterline, start = ref - dt.timedelta(days=90), ref - dt.timedelta(days=180)
        train, val = [k for k in known if k[1] < start], [k for k in known if start <= k[1] <= waterline]
        assert (r.waterline, r.val_start, r.n_train, r.n_val) == (waterline, start, len(train), len(val))
        ok = len({k[1].year for k in train}) >= 2
        own = [p for p in stored if p.fold == name]
        assert r.status == ("ok" if ok else "skipped") and len(own) == (len(val) if ok else 0)
        if not ok:
            assert r.mae is None
            continue
        assert sorted((p.sensor_id, p.date) for p in own) == sorted((k[0], k[1]) for k in val)
        errors = [abs(p.y - p.y_pred) for p in own]
        assert r.mae == pytest.approx(sum(errors) / len(errors)) and r.n_stations == len({p.sensor_id for p in own})
        by = {}
        for p in own:
            by.setdefault(p.sensor_id, []).append(abs(p.y - p.y_pred))
        assert r.mae_station_balanced == pytest.approx(statistics.mean(statistics.mean(e) for e in by.values()))
        climate = []
        for p in own:
            past = [k[2] for k in train if k[0] == p.sensor_id and k[1].month == p.date.month]
            if past:
                climate.append(abs(statistics.median(past) - p.y))
        assert r.mae_climatology == (pytest.approx(statistics.mean(climate)) if climate else None)
        yesterday = [abs(value[p.sensor_id, b] - p.y) for p in own if (p.sensor_id, b := p.date - dt.timedelta(days=1)) in value]
        assert r.mae_persistence == (pytest.approx(statistics.mean(yesterday)) if yesterday else None)
        if climate:
            assert r.skill_vs_climatology == pytest.approx(1 - r.mae / statistics.mean(climate))


def test_nothing_usable(spark):
    _, df = made(spark, years=1)
    metrics, predictions = backtest.monthly_backtest(df, ["x"], "2020-06-01", "2020-08-01", params=TINY)
    assert {r.status for r in metrics.collect()} == {"skipped"} and predictions.count() == 0
    per_fold, predictions = backtest.province_block_eval(df.where("false"), ["x"], params=TINY)
    assert per_fold.count() == 0 and predictions.count() == 0


def test_province_blocks(spark):
    rows, df = made(spark)
    per_fold, predictions = backtest.province_block_eval(df, ["x"], k=3, test_days=120, min_test_rows=20, params=TINY)
    folds = per_fold.collect()
    assert {(r.province, r.split_mode) for r in folds} == {("n", "stations"), ("n", "time"), ("p", "time")}
    bucket = {r.sensor_id: r.b for r in df.select("sensor_id", backtest.hash_bucket(F.col("sensor_id"), 3, 42).alias("b")).distinct().collect()}
    known = [r for r in rows if r[2] is not None]
    stored = predictions.collect()
    for r in folds:
        inside = [k for k in known if k[4] == r.province]
        if r.split_mode == "time":
            cutoff = max(k[1] for k in inside) - dt.timedelta(days=120)
            test, train = [k for k in inside if k[1] > cutoff], [k for k in known if k[1] <= cutoff]
        else:
            test = [k for k in inside if bucket[k[0]] == r.block]
            train = [k for k in known if k not in test]
        assert (r.n_test, r.n_train) == (len(test), len(train))
        for variant in ("base", "pool"):
            own = [p for p in stored if (p.fold, p.variant) == (f"{r.province}|{r.split_mode}|{r.block}", variant)]
            assert sorted((p.sensor_id, p.date) for p in own) == sorted((k[0], k[1]) for k in test)
            assert r[f"rmse_{variant}"] == pytest.approx(math.sqrt(statistics.mean((p.y - p.y_pred) ** 2 for p in own)))
        assert r.d_mae == pytest.approx(r.mae_pool - r.mae_base)
    (summary,) = [s for s in backtest.block_summary(per_fold).collect() if (s.province, s.split_mode) == ("n", "stations")]
    assert summary.mae_base_mean == pytest.approx(statistics.mean(r.mae_base for r in folds if r.split_mode == "stations"))


def test_bins_do_not_look_ahead(spark):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "sensor_id long, date date, pm25 double, x double")
    early = F.col("date") < "2020-02-01"
    assert max(backtest._edges(df.where(early), ["x"])[0][1:-1]) <= 30
    table = backtest.fold_table(df, ["x"], {"a": (early, ~early)}, ["date"], bins_from=early)
    assert table.rows.count() == 100 and [tuple(r) for r in table.sizes().collect()] == [("a", 31, 69)]
