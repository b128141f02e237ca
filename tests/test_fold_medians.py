"""Medians of many folds from the same passes over the rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hazeloom.operators import models, quantile
from hazeloom.operators.evaluate import evaluate_predictions


def test_fold_medians_equal_those_of_each_fold(spark):
    rng = random.Random(4)
    rows = [(i % 7, rng.choice([None, float("nan"), float(rng.randint(0, 3))]) if i % 3 else rng.gauss(0, 1e3), rng.gauss(1e9, 1e-3), None) for i in range(30_001)]
    df = spark.createDataFrame(rows, "g int, a double, b double, none double")
    folds = [F.col("g") != 0, F.col("g") < 3, F.col("g") == 5, F.lit(None).cast("boolean"), F.lit(True)]
    got = {(r.fold, r.column): r["median"] for r in quantile.fold_medians(df, ["a", "b", "none"], folds).collect()}
    held = [lambda g: g != 0, lambda g: g < 3, lambda g: g == 5, lambda g: False, lambda g: True]
    want = {}
    for i, h in enumerate(held):
        for at, name in ((1, "a"), (2, "b")):
            values = [r[at] for r in rows if h(r[0]) and r[at] is not None and r[at] == r[at]]
            if values:
                want[i, name] = statistics.median(values)
    assert got == {k: pytest.approx(v, rel=1e-15) for k, v in want.items()} and len(got) == 8


def test_fold_medians_of_nothing(spark):
    df = spark.createDataFrame([], "g int, a double")
    assert quantile.fold_medians(df, ["a"], [F.lit(True)]).count() == 0
    assert quantile.fold_medians(df, [], [F.lit(True)]).count() == 0


def test_fit_without_rows_that_stop_it(spark):
    rows = spark.createDataFrame([(float(i), float(i % 5), i % 2 == 0) for i in range(60)], "a double, pm25 double, flag boolean")
    params = models.TreeParams(rounds=2, depth=2)
    for flag in (F.lit(False), F.lit(True)):
        fitted = models.train_gbt(rows.withColumn("flag", flag), ["a"], val="flag", params=params)
        assert fitted.predict(rows).where("y_pred IS NOT NULL").count() == 60


def test_folds_share_the_passes_for_medians(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 4, None if i % 9 == 0 else float(i % 31), float(i % 7)) for i in range(400)], "g int, a double, pm25 double")
    folds = [(str(i), F.col("g") != i, F.col("g") == i) for i in range(4)]
    params = models.TreeParams(rounds=2, depth=2)
    alone = [models.train_gbt(rows.where(train), ["a"], params=params).predict(rows.where(test)) for _, train, test in folds]
    want = [evaluate_predictions(p, y="pm25").first().mae for p in alone]
    monkeypatch.setattr(models, "fit_medians", lambda *_: pytest.fail("a fold has its own passes"))
    got = {r.fold: r.mae for r in models.holdout_eval(rows, folds, ["a"], params=params).collect()}
    assert [got[str(i)] for i in range(4)] == pytest.approx(want)
