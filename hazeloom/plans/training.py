"""Registered queries: model training, comparison and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEASONS
from ..operators import assemble, backtest, models, spatial, splits
from ..operators.models import TreeParams
from ..operators.temporal import target_lags
from ..session import cut_lineage, scratch_path, stored
from ..sources.store import FeatureStore
from ..workflows import score_range
from .joins import CUBE_LAT, CUBE_LON, INSIDE
from .registry import REGISTRY, query

FEATURES = "WS10 blh RH WD10 sp t2m dT VC".split()
SMALL = TreeParams(rounds=3, depth=3, step=0.3)


_STORED: dict[tuple[str, str], DataFrame] = {}


def _rows(lake) -> DataFrame:
    """Station-days with weather features, province and provider; stored once per application and folder."""
    slot = (lake.spark.sparkContext.applicationId, lake.folder)
    if slot not in _STORED:
        table = (
            lake.station_daily()
            .drop("n")
            .join(lake.met_daily().select("sensor_id", "date", *FEATURES), ["sensor_id", "date"])
            .join(lake.stations().select("sensor_id", "province", "provider"), "sensor_id")
        )
        _STORED[slot] = stored(table, "rows")
    return _STORED[slot]


def _early(rows):
    return rows.where("date < '2024-01-21'"), rows.where("date >= '2024-01-21'")


def _key():
    return F.concat_ws("@", F.col("sensor_id").cast("string"), F.col("date").cast("string"))


def _networks(rows):
    return rows.where("provider = 'lowcost'"), rows.where("provider = 'regulatory'")


@query("train_gbt")
def _(lake):
    train, test = _early(_rows(lake))
    flagged = splits.random_holdout(train, _key())
    fitted = models.train_gbt(flagged, FEATURES, val="is_val", params=SMALL)
    return fitted.predict(test).select("sensor_id", "date", "pm25", "y_pred")


@query("train_forest")
def _(lake):
    train, test = _early(_rows(lake))
    return models.train_forest(train, FEATURES, trees=8, depth=5).predict(test).select("sensor_id", "date", "pm25", "y_pred")


@query("forest_quantiles")
def _(lake):
    train, test = _early(_rows(lake))
    forest = models.train_forest(train, FEATURES, trees=8, depth=5)
    return models.forest_quantiles(forest, test, {"q10": 0.1, "q50": 0.5, "q90": 0.9}).select("sensor_id", "date", "q10", "q50", "q90")


@query("feature_importance")
def _(lake):
    train, _test = _early(_rows(lake))
    return models.feature_importance(models.train_gbt(train, FEATURES, params=SMALL), lake.spark)


@query("random_search")
def _(lake):
    rows = _rows(lake)
    folds = [(F.col("date") < d, F.col("date").between(d, e)) for d, e in (("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-30"))]
    candidates = models.sample_params(3, {"depth": (2, 3, 4), "step": (0.1, 0.2, 0.3)}, rounds=3)
    return models.random_search(rows, FEATURES, folds, candidates)


@query(
    "yearly_rolling_cv",
    """SELECT year(date)::VARCHAR AS fold, count(*) AS n_predictions FROM yearly
      WHERE year(date) > (SELECT min(year(date)) FROM yearly) AND year(date) BETWEEN 1996 AND 2000 GROUP BY 1""",
)
def _(lake):
    days = lake.yearly().withColumns({"month": F.month("date").cast("double"), "weekday": F.dayofweek("date").cast("double")})
    metrics, _summary = models.yearly_rolling_cv(cut_lineage(days), ["month", "weekday"], range(1996, 2001), params=SMALL)
    return metrics.select("fold", "n_predictions")


@query("compare_models")
def _(lake):
    train, test = _early(_rows(lake))
    medians = stored(assemble.fit_medians(train, FEATURES), "medians")
    trainers = {
        "gbt": lambda d: models.train_gbt(d, FEATURES, params=SMALL, medians=medians),
        "forest": lambda d: models.train_forest(d, FEATURES, trees=8, depth=5, medians=medians),
    }
    return models.compare_models(train, test, trainers)


@query("feature_ablation")
def _(lake):
    train, test = _early(_rows(lake))
    families = {"wind": ["WS10", "WD10", "VC"], "thermal": ["t2m", "dT", "RH"], "pressure": ["sp", "blh"]}
    return models.feature_ablation(train, test, families, F.month("date").isin(SEASONS["winter"]), params=SMALL)


@query("two_stage_fit")
def _(lake):
    train, _test = _early(_rows(lake))
    low, reg = _networks(train)
    staged = models.two_stage_fit(low, reg, FEATURES, _key(), params=SMALL)
    return models.feature_importance(staged.residual, lake.spark)


@query("two_stage_predict")
def _(lake):
    train, test = _early(_rows(lake))
    low, reg = _networks(train)
    staged = models.two_stage_fit(low, reg, FEATURES, _key(), params=SMALL)
    return staged.predict(test).select("sensor_id", "date", "pm25", "backbone_pred", "y_pred")


_LAMBDA = """SELECT l/20.0::DOUBLE AS lambda, avg(abs(y_pred + l/20.0::DOUBLE*(y_true*0.1 - 5) - y_true)) AS mae FROM predictions, range(11) t(l) GROUP BY 1"""


@query("lambda_grid", _LAMBDA.replace("AS lambda", 'AS "lambda"'), doubles="mae")
def _(lake):
    p = lake.predictions().withColumn("residual", F.col("y_true") * 0.1 - 5)
    return models.lambda_grid(p, "y_pred", "residual", "y_true")


@query("global_model")
def _(lake):
    train, test = _early(_rows(lake))
    low, reg = _networks(train)
    return models.global_model(low, reg, FEATURES, _key(), params=SMALL).predict(test).select("sensor_id", "date", "pm25", "y_pred")


@query("weighted_global")
def _(lake):
    train, test = _early(_rows(lake))
    low, reg = _networks(train)
    return models.weighted_global(low, reg, FEATURES, _key(), params=SMALL).predict(test).select("sensor_id", "date", "pm25", "y_pred")


@query("anchor_only")
def _(lake):
    train, test = _early(_rows(lake))
    _low, reg = _networks(train)
    return models.anchor_only(reg, FEATURES, params=SMALL).predict(test).select("sensor_id", "date", "pm25", "y_pred")


@query("alignment_cv")
def _(lake):
    low, reg = _networks(_rows(lake))
    return models.alignment_cv(low, reg, FEATURES, _key(), k=2, params=TreeParams(rounds=2, depth=2, step=0.5))


@query("lopo_eval")
def _(lake):
    rows = _rows(lake)
    # provinces are a handful of names
    names = [r.province for r in splits.leave_one_province_out(rows).select("province").orderBy("province").collect()]
    folds = [(p, F.col("province") != p, F.col("province") == p) for p in names]
    return models.holdout_eval(rows, folds, FEATURES, params=SMALL)


def blocks_of(rows):
    """The (province, fold) pairs to hold out."""
    return rows.where("fold IS NOT NULL AND province IS NOT NULL").select("province", "fold").distinct().collect()


@query("spatial_block_eval")
def _(lake):
    """Five folds of blocks in every province, each fitted with the operator's own settings."""
    blocks = splits.spatial_block_folds(lake.stations(), 5).select("sensor_id", "fold")
    rows = stored(_rows(lake).join(blocks, "sensor_id"), "blocks")
    folds = []
    for name, i in sorted(tuple(r) for r in blocks_of(rows)):
        held = F.coalesce((F.col("province") == name) & (F.col("fold") == i), F.lit(False))
        folds.append((f"{name} block {i}", ~held, held))
    return models.holdout_eval(rows, folds, FEATURES)


@query("sensor_block_eval")
def _(lake):
    rows = splits.sensor_kfold_in_province(_rows(lake), "ASIA", 2)
    held = [(f"ASIA stations {i}", F.coalesce(F.col("fold") != i, F.lit(True)), F.col("fold") == i) for i in range(2)]
    plain = models.holdout_eval(rows, held, FEATURES, params=SMALL).withColumn("province_feature", F.lit(0))
    labelled = models.holdout_eval(rows, held, FEATURES, categories=["province"], params=SMALL)
    return plain.unionByName(labelled.withColumn("province_feature", F.lit(1)))


@query("score_grid")
def _(lake):
    path = scratch_path(lake.spark, "model")
    models.train_gbt(_rows(lake), FEATURES, params=SMALL).save(path)
    fitted = models.load_fitted(lake.spark, path)
    e = F.col("event_id")
    cells = (
        lake.met_readings()
        .groupBy(F.to_date("ts").alias("date"), (e % 11).alias("iy"), (e % 13).alias("ix"))
        .agg(*[F.avg(c).alias(c) for c in ("WS10", "blh", "RH", "WD10", "sp", "t2m", "d2m")])
        .withColumns({"dT": F.col("t2m") - F.col("d2m"), "VC": F.col("WS10") * F.col("blh")})
        .withColumns({"lat": CUBE_LAT.value(F.col("iy")), "lon": CUBE_LON.value(F.col("ix"))})
        .withColumn("cell", F.concat_ws("_", F.col("iy").cast("string"), F.col("ix").cast("string")))
    )
    # the mask depends on the cell alone, so it is worked out once per cell, not per day
    mask = spatial.country_mask(cells.select("cell", "lat", "lon").distinct(), lake.polygon_edges())
    masked = cells.join(mask.select("cell", "inside"), "cell")
    return models.score_grid(fitted, masked, F.col("inside")).select("date", "iy", "ix", "pm25")


_CELL_POINTS = "SELECT DISTINCT event_id % 11 AS iy, event_id % 13 AS ix, iy || '_' || ix AS k, 37.3::DOUBLE - 1.4*iy AS lat, 60.5::DOUBLE + 1.45*ix AS lon FROM events"


@query(
    "score_range",
    f"""WITH pts AS ({_CELL_POINTS}), i AS (SELECT DISTINCT k FROM ({INSIDE})),
      d AS (SELECT DISTINCT CAST(ts AS DATE) AS date, event_id % 11 || '_' || event_id % 13 AS cell_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')
      SELECT date, cell_id, i.k IS NOT NULL AS scored, true AS usable FROM d LEFT JOIN i ON i.k = d.cell_id""",
)
def _(lake):
    """A stored grid, a saved model, one job for the range."""
    e = F.col("event_id")
    store, path = FeatureStore(lake.spark, scratch_path(lake.spark, "grid")), scratch_path(lake.spark, "model")
    days = lake.met_readings().groupBy(F.to_date("ts").alias("date"), (e % 11).alias("iy"), (e % 13).alias("ix"))
    days = cut_lineage(days.agg(*[F.avg(c).alias(c) for c in ("WS10", "blh", "RH", "WD10", "sp", "t2m", "d2m")]))
    days = days.withColumn("cell_id", F.concat_ws("_", F.col("iy").cast("string"), F.col("ix").cast("string")))
    store.write("met", days.select("date", "cell_id", "WS10", "blh", "RH", "WD10", "sp"))
    store.write("heat", days.select("date", "cell_id", "t2m", (F.col("t2m") - F.col("d2m")).alias("dT"), (F.col("WS10") * F.col("blh")).alias("VC")))
    models.train_gbt(_rows(lake), FEATURES, params=SMALL).save(path)
    cells = days.select("cell_id", CUBE_LAT.value(F.col("iy")).alias("lat"), CUBE_LON.value(F.col("ix")).alias("lon")).distinct()
    cells = spatial.country_mask(cells, lake.polygon_edges())
    out = score_range(store, models.load_fitted(lake.spark, path), cells, ["met", "heat"], "2024-01-10", "2024-01-20")
    usable = F.col("pm25").isNull() | ((F.col("pm25") >= 0) & ~F.isnan("pm25"))
    return out.select("date", "cell_id", F.col("pm25").isNotNull().alias("scored"), usable.alias("usable"))


@query("score_validation_pair")
def _(lake):
    rows = _rows(lake)
    history = ["pm25_lag1", "pm25_lag2", "pm25_lag3"]
    lagged = cut_lineage(target_lags(rows, lags=(1, 2, 3)).withColumn("log_pm25", F.log1p("pm25")))
    train, test = _early(lagged)
    dropped = splits.history_dropout(train, history, _key())
    fitted = models.train_gbt(dropped, [*FEATURES, *history], "log_pm25", params=SMALL)
    out = models.score_validation_pair(fitted, test, history)
    return out.select("sensor_id", "date", "pm25", "pred_with_history", "pred_no_history")


def _again(predictions, by):
    """Metrics of stored predictions, written out in SQL."""
    return lambda spark: spark.sql(
        f"""SELECT {by}, avg(abs(y_pred - y)) AS mae2, sqrt(avg((y_pred - y) * (y_pred - y))) AS rmse2, count(*) AS n2,
          1 - sum((y_pred - y) * (y_pred - y)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0) AS r22
        FROM {{p}} GROUP BY ALL""", p=predictions
    )


def _close(a, b):
    return F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-6 * (1 + F.abs(F.col(a))), F.col(a).isNull() & F.col(b).isNull())


_YEARLY = "WITH y AS (SELECT * FROM yearly), m AS (SELECT range::DATE AS ref FROM range(DATE '1996-01-01', DATE '1998-02-01', INTERVAL 1 MONTH))"


@query(
    "monthly_backtest",
    f"""{_YEARLY},
      s AS (SELECT ref, ref - 90 AS waterline, ref - 180 AS val_start, count(*) FILTER (date < ref - 180) AS n_train,
        count(*) FILTER (date BETWEEN ref - 180 AND ref - 90) AS n_val, count(DISTINCT CASE WHEN date < ref - 180 THEN year(date) END)::INTEGER AS train_years,
        count(DISTINCT CASE WHEN date BETWEEN ref - 180 AND ref - 90 THEN sensor_id END) AS n_stations
        FROM m, y WHERE pm25 IS NOT NULL GROUP BY 1),
      o AS (SELECT *, train_years >= 2 AND n_val > 0 AS ok FROM s)
      SELECT ref::VARCHAR AS reference_date, waterline, val_start, CASE WHEN ok THEN 'ok' ELSE 'skipped' END AS status, n_train, n_val, train_years,
        CASE WHEN ok THEN n_stations END AS n_stations, CASE WHEN ok THEN n_val END AS n_predictions, CASE WHEN ok THEN true END AS metrics_agree FROM o""",
)
def _(lake):
    days = lake.yearly().withColumns({"month": F.month("date").cast("double"), "weekday": F.dayofweek("date").cast("double")})
    metrics, predictions = backtest.monthly_backtest(days, ["month", "weekday"], "1996-01-01", "1998-01-01", params=SMALL)
    again = _again(predictions, "fold AS reference_date")(lake.spark)
    agree = _close("mae", "mae2") & _close("rmse", "rmse2") & _close("r2", "r22")
    names = ["reference_date", "waterline", "val_start", "status", "n_train", "n_val", "train_years", "n_stations"]
    return metrics.join(again, "reference_date", "left").select(*names, F.col("n2").alias("n_predictions"), F.when(F.col("status") == "ok", agree).alias("metrics_agree"))


_DAYS = """SELECT d.sensor_id, d.date, d.pm25, s.province FROM station_daily d JOIN met_daily USING (sensor_id, date) JOIN stations s ON s.sensor_id = d.sensor_id
  WHERE d.pm25 IS NOT NULL"""
_FOLD = "(('0x' || substr(md5('42:' || sensor_id), 1, 8))::BIGINT % 5)::INTEGER"


@query(
    "province_block_eval",
    f"""WITH d AS ({_DAYS}), p AS (SELECT province, count(DISTINCT sensor_id) AS k, max(date) - 7 AS cutoff FROM d GROUP BY 1),
      b AS (SELECT province, 'stations' AS split_mode, i::INTEGER AS block, cutoff FROM p, range(5) t(i) WHERE k >= 5
        UNION ALL SELECT province, 'time', 0, cutoff FROM p),
      x AS (SELECT b.province, b.split_mode, b.block,
        CASE WHEN split_mode = 'time' THEN d.date <= b.cutoff ELSE NOT (d.province = b.province AND {_FOLD} = b.block) END AS train,
        d.province = b.province AND CASE WHEN split_mode = 'time' THEN d.date > b.cutoff ELSE {_FOLD} = b.block END AS test FROM b, d)
      SELECT province, split_mode, block, count(*) FILTER (train) AS n_train, count(*) FILTER (test) AS n_test,
        count(*) FILTER (test) AS n_base, count(*) FILTER (test) AS n_pool, true AS metrics_agree FROM x GROUP BY 1, 2, 3 HAVING count(*) FILTER (test) >= 1""",
)
def _(lake):
    per_fold, predictions = backtest.province_block_eval(_rows(lake), FEATURES, test_days=7, min_test_rows=1, params=SMALL)
    again = _again(predictions, "fold, variant")(lake.spark).groupBy("fold").agg(
        *[F.max(F.when(F.col("variant") == v, F.col(f"{m}2"))).alias(f"{m}_{v}2") for v in ("base", "pool") for m in ("mae", "rmse", "n")]
    )
    joined = per_fold.join(again, F.concat_ws("|", "province", "split_mode", F.col("block").cast("string")) == F.col("fold"), "left")
    agree = _close("mae_base", "mae_base2") & _close("mae_pool", "mae_pool2") & _close("rmse_base", "rmse_base2") & _close("rmse_pool", "rmse_pool2")
    same = F.abs(F.col("mae_pool2") - F.col("mae_base2") - F.col("d_mae")) < 1e-6
    return joined.select("province", "split_mode", "block", "n_train", "n_test", F.col("n_base2").alias("n_base"), F.col("n_pool2").alias("n_pool"), (agree & same).alias("metrics_agree"))


def _scored(df, predictions):
    """A row for each test row, every prediction a number, and the errors smaller than those of one number for all."""
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("pm25")))
    known = [F.count_if(F.col(c).isNotNull() & ~F.isnan(c)) == F.count(F.lit(1)) for c in predictions]
    middle = df.agg(F.avg("pm25")).scalar()
    ok = (F.countDistinct("sensor_id", "date") == F.count(F.lit(1))) & (error(predictions[0]) < F.avg(F.abs(F.col("pm25") - F.col("_m"))))
    for k in known:
        ok = ok & k
    return df.withColumn("_m", middle).agg(F.count(F.lit(1)).alias("n_rows"), ok.alias("ok"))


def _checked(df, condition):
    """The number of rows, and whether all of them meet a condition."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.coalesce(condition, F.lit(False))).alias("ok"))


def _importances(df):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), ((F.abs(F.sum("importance") - 1) < 1e-6) & (F.min("importance") >= 0)).alias("ok"))


def _metrics(df):
    return _checked(df, (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-9))


def _ablation(df):
    full = df.where("experiment = 'full'").select("scope", F.col("mae").alias("_f"))
    zero = F.abs(F.col("delta_mae") - (F.col("mae") - F.col("_f"))) < 1e-9
    return _checked(df.join(full, "scope", "left"), zero | F.col("mae").isNull())


_TEST_ROWS = "(SELECT count(*) FROM d WHERE date >= DATE '2024-01-21')"
_ALL_DAYS = "WITH d AS (SELECT s.sensor_id, s.date, s.pm25, t.province, t.provider FROM station_daily s JOIN met_daily USING (sensor_id, date) JOIN stations t ON t.sensor_id = s.sensor_id)"
#: What each model query must satisfy, and the SQL of its number of rows.
CHECKS = {
    "train_gbt": (lambda d: _scored(d, ["y_pred"]), _TEST_ROWS),
    "train_forest": (lambda d: _scored(d, ["y_pred"]), _TEST_ROWS),
    "forest_quantiles": (lambda d: _checked(d, (F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90"))), _TEST_ROWS),
    "two_stage_predict": (lambda d: _scored(d, ["y_pred", "backbone_pred"]), _TEST_ROWS),
    "global_model": (lambda d: _scored(d, ["y_pred"]), _TEST_ROWS),
    "weighted_global": (lambda d: _scored(d, ["y_pred"]), _TEST_ROWS),
    "anchor_only": (lambda d: _scored(d, ["y_pred"]), _TEST_ROWS),
    "score_validation_pair": (lambda d: _scored(d, ["pred_with_history", "pred_no_history"]), _TEST_ROWS),
    "feature_importance": (_importances, "8"),
    "two_stage_fit": (_importances, "9"),
    "random_search": (_metrics, "3"),
    "compare_models": (_metrics, "2"),
    "feature_ablation": (_ablation, "14"),
    "alignment_cv": (lambda d: _checked(d, F.col("n") == F.col("_n")), "9"),
    "lopo_eval": (_metrics, "(SELECT count(*) FROM (SELECT province FROM d GROUP BY 1 HAVING count(DISTINCT sensor_id) >= 2 AND count(*) >= 30))"),
    "score_grid": (
        lambda d: _checked(d, F.col("pm25").isNull() | (F.col("pm25") >= 0)),
        "(SELECT count(*) FROM (SELECT DISTINCT CAST(ts AS DATE), event_id % 11, event_id % 13 FROM met_readings))",
    ),
}


def _register_checks(title, names):
    counts = " UNION ALL ".join(f"SELECT '{n}' AS model, {CHECKS[n][1]}::BIGINT AS n_rows, true AS ok" for n in names)

    @query(title, f"{_ALL_DAYS} SELECT * FROM ({counts})")
    def _(lake):
        parts = []
        for name in names:
            found = REGISTRY[name].run(lake.spark, lake.folder)
            if name == "alignment_cv":  # every regulatory row with a value is scored once by each approach
                _low, reg = _networks(_rows(lake))
                found = found.withColumn("_n", reg.where("pm25 IS NOT NULL").agg(F.count(F.lit(1))).scalar())
            parts.append(cut_lineage(CHECKS[name][0](found).select(F.lit(name).alias("model"), "n_rows", "ok")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


_names = list(CHECKS)
_register_checks("prediction_checks", _names[:4])
_register_checks("network_checks", _names[4:8])
_register_checks("importance_checks", _names[8:12])
_register_checks("evaluation_checks", _names[12:])
