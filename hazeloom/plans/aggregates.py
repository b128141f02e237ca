"""Registered queries: station summaries, robust statistics, metrics, calibration and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AQI_CATEGORY_LABELS
from ..functions.quality import mode_in_range
from ..functions.timecols import season_label
from ..operators import assemble, calibrate, evaluate, grids, pixels, stations
from .joins import _FILE_KEYS, _window, per_point, window_pixels
from .registry import query

_HOURLY = "SELECT user_id AS sensor_id, date_trunc('hour', ts) AS hour, avg(value) AS pm25 FROM events GROUP BY 1, 2"


@query(
    "station_hourly_to_daily",
    f"""WITH h AS ({_HOURLY}), v AS (SELECT sensor_id, hour, CASE WHEN pm25 BETWEEN 0 AND 400 AND pm25 NOT IN (-999, 985) THEN pm25 END AS x FROM h),
      w AS (SELECT *, abs(x - lag(x) OVER s) > 60 AND abs(x - lead(x) OVER s) > 60 AS spike,
        count(x) OVER f = 3 AND max(x) OVER f = min(x) OVER f AS flat FROM v
        WINDOW s AS (PARTITION BY sensor_id ORDER BY hour), f AS (PARTITION BY sensor_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
      q AS (SELECT sensor_id, hour, CASE WHEN NOT coalesce(spike, false) AND NOT coalesce(flat, false) THEN x END AS x FROM w)
      SELECT sensor_id, CAST(hour AS DATE) AS date, avg(x) AS pm25_mean, median(x) AS pm25_median, quantile_cont(x, 0.95) AS pm25_p95,
        count(x) AS n_hours_valid, (count(x) >= 3)::INTEGER AS complete FROM q GROUP BY 1, 2""",
    doubles="pm25_mean pm25_median pm25_p95",
)
def _(lake):
    checked = stations.quality_control(stations.hourly_readings(lake.readings()), high=400.0, max_step=60.0, flat_run=3)
    return stations.hourly_to_daily(checked, min_hours=3)


_DMM = "WS10 blh RH".split()


@query(
    "daily_mean_max_min",
    "SELECT sensor_id, CAST(ts AS DATE) AS date, "
    + ", ".join(f"{f}({v}) AS {v}_daily_{s}" for v in _DMM for s, f in (("mean", "avg"), ("max", "max"), ("min", "min")))
    + " FROM met_readings GROUP BY 1, 2",
    doubles=" ".join(f"{v}_daily_{s}" for v in _DMM for s in ("mean", "max", "min")),
)
def _(lake):
    return stations.daily_mean_max_min(lake.met_readings(), _DMM)


@query(
    "unfold_valid_time",
    """SELECT valid_time, sensor_id, arg_min(pm25, CASE WHEN pm25 IS NOT NULL THEN step END) AS pm25 FROM (
      SELECT base + to_hours(step) AS valid_time, sensor_id, step, avg(pm25) AS pm25 FROM (
        SELECT user_id AS sensor_id, CAST(ts AS DATE)::TIMESTAMP + to_hours(12*(event_id % 2)) AS base, 6*(event_id % 4) AS step,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS pm25 FROM events) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    doubles="pm25",
)
def _(lake):
    e = F.col("event_id")
    base = F.timestamp_add("HOUR", (12 * (e % 2)).cast("int"), F.date_trunc("day", "ts"))
    raw = lake.readings().select(
        "sensor_id", base.alias("time"), (6 * (e % 4)).cast("int").alias("step"), F.when(e % 5 != 0, F.col("pm25")).alias("pm25")
    )
    # one row per (station, valid time, step), as in a forecast cube
    valid = F.timestamp_add("HOUR", F.col("step"), F.col("time"))
    cube = raw.groupBy("sensor_id", valid.alias("_v"), "step").agg(F.avg("pm25").alias("pm25"))
    cube = cube.withColumn("time", F.timestamp_add("HOUR", -F.col("step"), F.col("_v")))
    out = grids.unfold_valid_time(cube, ["sensor_id"], ["pm25"])
    return out.withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))


@query(
    "fill_bad_first_hour",
    """WITH h AS (SELECT sensor_id, date, CASE WHEN date > (SELECT min(date) FROM station_daily) THEN pm25 END AS pm25 FROM station_daily)
      SELECT sensor_id, date, CASE WHEN date = (SELECT min(date) FROM h) THEN lead(pm25) OVER (PARTITION BY sensor_id ORDER BY date) ELSE pm25 END AS pm25 FROM h""",
    doubles="pm25",
)
def _(lake):
    daily = lake.station_daily().drop("n")
    first = daily.agg(F.min("date")).scalar()
    emptied = daily.withColumn("pm25", F.when(F.col("date") > first, F.col("pm25")))
    return grids.fill_bad_first_hour(emptied, ["sensor_id"], "date", ["pm25"])


@query(
    "clamp_to_month",
    """SELECT sensor_id, date, pm25 FROM yearly WHERE date_trunc('month', date) = (SELECT m FROM (
      SELECT date_trunc('month', date) AS m, count(*) AS n FROM (SELECT DISTINCT date FROM yearly) GROUP BY 1) ORDER BY n DESC, m LIMIT 1)""",
    doubles="pm25",
)
def _(lake):
    return grids.clamp_to_month(lake.yearly(), "date")


@query(
    "mixing_features",
    """WITH v AS (SELECT event_id, event_id % 50 AS cell, month(ts) AS mo, WS10*blh AS VC FROM met_readings),
      q AS (SELECT cell, mo, quantile_cont(VC, 0.25) AS q1, median(VC) AS q2, quantile_cont(VC, 0.75) AS q3 FROM v GROUP BY 1, 2)
      SELECT event_id, VC, CASE WHEN q3 > q1 THEN CASE WHEN (VC-q2)/(q3-q1) < -3 THEN -3 WHEN (VC-q2)/(q3-q1) > 3 THEN 3 ELSE (VC-q2)/(q3-q1) END END AS VCi
      FROM v LEFT JOIN q USING (cell, mo)""",
    doubles="VC VCi",
)
def _(lake):
    rows = lake.met_readings().withColumn("cell", F.col("event_id") % 50)
    return grids.mixing_features(rows, "cell", F.month("ts")).select("event_id", "VC", "VCi")


@query(
    "regime_flags",
    """WITH v AS (SELECT m.event_id, s.lat BETWEEN 24 AND 34 AS inside, WS10*blh AS VC, RH FROM met_readings m JOIN stations s USING (sensor_id))
      SELECT event_id, CASE WHEN inside THEN coalesce(VC < (SELECT quantile_cont(VC, 0.4) FROM v WHERE inside), false)::INTEGER ELSE -1 END AS Stagnant,
        CASE WHEN inside THEN coalesce(RH > 85, false)::INTEGER ELSE -1 END AS HighRH FROM v""",
)
def _(lake):
    rows = lake.met_readings().join(lake.stations().select("sensor_id", "lat"), "sensor_id")
    rows = rows.withColumns({"inside": F.col("lat").between(24, 34), "VC": F.col("WS10") * F.col("blh")})
    return grids.regime_flags(rows, "inside").select("event_id", "Stagnant", "HighRH")


def _robust_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(v) AS n_pixels, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, median(v) AS median,
      quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90,
      quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, mad(v) AS mad, max(v) - min(v) AS range, stddev_pop(v)/(abs(avg(v)) + 1e-12) AS cv,
      CASE WHEN count(v) < 3 THEN NULL WHEN stddev_pop(v) <= 1e-12 THEN 0
        ELSE (avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*pow(avg(v),3))/pow(stddev_pop(v),3) END AS skew,
      CASE WHEN count(v) < 4 THEN NULL WHEN stddev_pop(v) <= 1e-12 THEN 0 ELSE kurtosis_pop(v) END AS kurt
      FROM ({source}) GROUP BY {keys}"""


_ROBUST = "mean std min max median p10 p25 p75 p90 iqr mad range cv skew kurt"


@query(
    "robust_window_stats",
    _robust_sql(f"SELECT sensor_id, date, product, CASE WHEN qa >= 0.75 THEN value/1000 END AS v FROM ({_window(3)})", "sensor_id, date, product"),
    doubles=_ROBUST,
    digits=4,
)
def _(lake):
    def compute(addresses):
        rows = window_pixels(addresses, lake, 3).withColumn("v", F.when(F.col("qa") >= 0.75, F.col("value") / 1000))
        return pixels.robust_window_stats(rows, _FILE_KEYS, "v")

    return per_point(lake, compute)


@query(
    "daily_pixel_mean",
    "SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS product, l_orderkey % 40 AS prow, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3",
    doubles="value",
)
def _(lake):
    passes = lake.table("lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("product"),
        (F.col("l_orderkey") % 40).alias("prow"),
        F.col("l_extendedprice").alias("value"),
    )
    return pixels.daily_pixel_mean(passes, ["date", "product", "prow"])


@query(
    "raster_decimate",
    "SELECT date, product, (prow//4)::INTEGER AS brow, (pcol//4)::INTEGER AS bcol, avg(value) AS value FROM gas_pixels GROUP BY 1, 2, 3, 4",
    doubles="value",
)
def _(lake):
    return pixels.raster_decimate(lake.gas_pixels(), 4, ["date", "product"])


@query(
    "mode_int",
    """SELECT sensor_id, m AS mode FROM (SELECT user_id AS sensor_id, event_id % 9 AS m, count(*) AS n FROM events WHERE event_id % 9 <= 7 GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY n DESC, m) = 1""",
)
def _(lake):
    return lake.readings().groupBy("sensor_id").agg(mode_in_range(F.col("event_id") % 9, 7).alias("mode"))


@query(
    "aod_coverage_audit",
    """SELECT date, file_share, value_share, CASE WHEN file_share > 0.5 AND value_share < 0.3 THEN 'low_retrieval' WHEN file_share < 0.3 THEN 'missing_tiles' ELSE 'ok' END AS warning
      FROM (SELECT date, avg((value IS NOT NULL)::INTEGER::DOUBLE) AS file_share, avg((value IS NOT NULL AND qa > 0.905 AND value > 60000)::INTEGER::DOUBLE) AS value_share
      FROM gas_pixels GROUP BY 1)""",
    doubles="file_share value_share",
)
def _(lake):
    cells = lake.gas_pixels().select(
        "date",
        F.col("value").isNotNull().alias("has_file"),
        F.when((F.col("qa") > 0.905) & (F.col("value") > 60000), F.col("value")).alias("value"),
    )
    return grids.aod_coverage_audit(cells)


@query(
    "grid_window_stat",
    """WITH c AS (SELECT date, iy, ix, value FROM met_cube), o AS (SELECT dy, dx FROM (VALUES (-1),(0),(1)) a(dy), (VALUES (-1),(0),(1)) b(dx))
      SELECT c.date, c.iy AS prow, c.ix AS pcol, avg(n.value) AS value FROM c CROSS JOIN o
      LEFT JOIN met_cube n ON n.date = c.date AND n.iy = greatest(0, least(10, c.iy + dy)) AND n.ix = greatest(0, least(12, c.ix + dx)) GROUP BY 1, 2, 3""",
    doubles="value",
)
def _(lake):
    grid = lake.met_cube().withColumnsRenamed({"iy": "prow", "ix": "pcol"})
    return pixels.grid_window_stat(grid, ["date"], 1, "mean", 11, 13)


_ACTIVITY = """SELECT s.sensor_id, arg_min(s.lat, d.date) AS lat, arg_min(s.lon, d.date) AS lon, any_value(s.province) AS province, any_value(s.provider) AS provider,
  count(DISTINCT d.date) AS days_present, sum((d.pm25 IS NOT NULL AND d.n >= 2)::INTEGER)::BIGINT AS valid_days, avg(d.pm25) AS mean_pm25,
  avg(d.n) AS mean_valid_hours, (sum((d.pm25 IS NOT NULL AND d.n >= 2)::INTEGER) >= 5)::INTEGER AS active
  FROM station_daily d JOIN stations s USING (sensor_id) WHERE d.date BETWEEN DATE '2024-01-30' - 30 AND DATE '2024-01-30' GROUP BY 1"""


def _network(lake):
    daily = lake.station_daily().withColumnRenamed("n", "valid_hours")
    return daily.join(lake.stations(), "sensor_id")


def _activity(lake):
    return stations.station_activity(_network(lake), "2024-01-30", min_valid_days=5, min_hours=2)


@query("station_activity", _ACTIVITY, doubles="lat lon mean_pm25 mean_valid_hours")
def _(lake):
    return _activity(lake)


@query(
    "network_growth",
    """SELECT date, count(DISTINCT sensor_id) AS n_stations FROM yearly WHERE month(date) IN (1, 7) AND day(date) = 1 GROUP BY 1""",
)
def _(lake):
    return stations.network_growth(lake.yearly())


@query("active_by_region", f"SELECT province, count(*) AS n_active FROM ({_ACTIVITY}) WHERE active = 1 GROUP BY 1")
def _(lake):
    return stations.active_by_region(_activity(lake))


@query(
    "provider_summary",
    f"""WITH a AS ({_ACTIVITY}) SELECT provider, count(*) AS total, sum(active)::BIGINT AS active, sum(1 - active)::BIGINT AS inactive,
      any_value(h) AS mean_valid_hours FROM a JOIN (SELECT provider, avg(n) AS h FROM station_daily JOIN stations USING (sensor_id) GROUP BY 1) USING (provider) GROUP BY 1""",
    doubles="mean_valid_hours",
)
def _(lake):
    return stations.provider_summary(_activity(lake), lake.station_daily().withColumnRenamed("n", "valid_hours"))


@query(
    "active_bounds",
    f"SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM ({_ACTIVITY}) WHERE active = 1",
    doubles="lat_min lat_max lon_min lon_max",
)
def _(lake):
    return stations.active_bounds(_activity(lake))


@query(
    "network_by_era",
    """SELECT CASE WHEN year(date) BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN year(date) BETWEEN 1997 AND 1998 THEN '1997-1998' ELSE '1999-2001' END AS era,
      count(DISTINCT sensor_id) AS n_stations FROM yearly WHERE year(date) BETWEEN 1995 AND 2001 GROUP BY 1""",
)
def _(lake):
    return stations.network_by_era(lake.yearly(), [(1995, 1996), (1997, 1998), (1999, 2001)])


_COLS = "WS10 blh RH WD10 sp t2m d2m".split()


@query(
    "feature_coverage",
    "SELECT UNNEST([" + ", ".join(f"'{c}'" for c in _COLS) + "]) AS column_name, UNNEST(["
    + ", ".join(f"count({c})/count(*)::DOUBLE" for c in _COLS) + "]) AS coverage, 1 AS keep FROM met_readings",
    doubles="coverage",
)
def _(lake):
    return assemble.feature_coverage(lake.met_readings(), _COLS)


@query(
    "fit_medians",
    "SELECT UNNEST([" + ", ".join(f"'{c}'" for c in _COLS) + "]) AS column, UNNEST([" + ", ".join(f"median({c})" for c in _COLS) + "]) AS median FROM met_readings",
    doubles="median",
)
def _(lake):
    return assemble.fit_medians(lake.met_readings(), _COLS)


@query(
    "median_impute",
    "SELECT event_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM met_readings WHERE ts < TIMESTAMP '2024-01-20')) AS {c}" for c in _COLS) + " FROM met_readings",
    doubles=" ".join(_COLS),
)
def _(lake):
    rows = lake.met_readings()
    train = rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return assemble.median_impute(rows, _COLS, assemble.fit_medians(train, _COLS)).select("event_id", *_COLS)


@query(
    "duplicate_key_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(lake):
    return assemble.duplicate_keys(lake.table("lineitem"), ["l_orderkey", "l_linenumber"])


_STAGES = {"met": ["WS10", "blh", "RH"], "aod": ["sp", "missing_one"], "tropomi": ["t2m"]}
_REQUIRED = ["WS10", "blh", "RH", "sp", "missing_one", "t2m"]
_ISNULL = {c: f"({c} IS NULL)::INTEGER" for c in "WS10 blh RH sp t2m".split()}


@query(
    "data_quality_report",
    f"""SELECT date, 6 AS total_features, 1 AS missing_features, 5 AS available_features,
      round(avg(({" + ".join(_ISNULL.values())})/5.0::DOUBLE), 4) AS nan_fraction, count(*) AS country_cells,
      round(avg((coalesce(WS10, blh, RH) IS NOT NULL)::INTEGER), 4) AS met_coverage, round(avg((sp IS NOT NULL)::INTEGER), 4) AS aod_coverage,
      round(avg((t2m IS NOT NULL)::INTEGER), 4) AS tropomi_coverage, round(avg(({_ISNULL["WS10"]} + {_ISNULL["blh"]} + {_ISNULL["RH"]})/3.0::DOUBLE), 4) AS met_nan,
      round(avg({_ISNULL["sp"]}), 4) AS aod_nan, round(avg({_ISNULL["t2m"]}), 4) AS tropomi_nan, 3 AS met_features, 1 AS aod_features, 1 AS tropomi_features
      FROM met_daily JOIN stations USING (sensor_id) WHERE lat BETWEEN 24 AND 34 GROUP BY 1""",
    doubles="nan_fraction met_coverage aod_coverage tropomi_coverage met_nan aod_nan tropomi_nan",
)
def _(lake):
    placed = lake.met_daily().join(lake.stations().select("sensor_id", "lat"), "sensor_id")
    report = assemble.data_quality_report(placed, _STAGES, _REQUIRED, F.col("lat").between(24, 34))
    return assemble.flatten_quality(report, list(_STAGES))


@query(
    "grid_day_stats",
    """SELECT date, avg(y_pred) AS mean, min(y_pred) AS min, max(y_pred) AS max, stddev_pop(y_pred) AS std, count(y_pred) AS n_valid, count(*) AS n_total,
      median(y_pred) AS median, quantile_cont(y_pred, 0.05) AS p05, quantile_cont(y_pred, 0.95) AS p95 FROM predictions GROUP BY 1""",
    doubles="mean min max std median p05 p95",
)
def _(lake):
    return grids.grid_day_stats(lake.predictions(), "y_pred")


@query(
    "aqi_day_summary",
    """SELECT date, avg(y_pred) AS mean, max(y_pred) AS max, min(y_pred) AS min, stddev_pop(y_pred) AS std, 100*avg((y_pred < 9)::INTEGER) AS good_pct,
      100*avg((y_pred > 55.4)::INTEGER) AS unhealthy_pct, median(y_pred) AS median, quantile_cont(y_pred, 0.95) AS p95 FROM predictions GROUP BY 1""",
    doubles="mean max min std good_pct unhealthy_pct median p95",
)
def _(lake):
    return grids.aqi_day_summary(lake.predictions(), "y_pred")


_CAT = "CASE WHEN y_pred <= 9.0 THEN 0 WHEN y_pred <= 35.4 THEN 1 WHEN y_pred <= 55.4 THEN 2 WHEN y_pred <= 125.4 THEN 3 WHEN y_pred <= 225.4 THEN 4 ELSE 5 END"


@query(
    "aqi_category_share",
    f"""SELECT date, {", ".join(f"100*avg((cat = {i})::INTEGER) AS pct_{i}" for i in range(6))}, count(*) AS n,
      list_extract([{", ".join(repr(x) for x in AQI_CATEGORY_LABELS)}], max(cat) + 1) AS worst FROM (SELECT date, {_CAT} AS cat FROM predictions) GROUP BY 1""",
    doubles=" ".join(f"pct_{i}" for i in range(6)),
)
def _(lake):
    return grids.aqi_category_share(lake.predictions(), "y_pred")


@query(
    "frame_scale",
    """SELECT date, CASE WHEN ok THEN greatest(10, p01) ELSE 10 END AS vmin, CASE WHEN ok THEN least(180, p99) ELSE 180 END AS vmax,
      (SELECT min(y_pred) FROM predictions) AS period_min, (SELECT max(y_pred) FROM predictions) AS period_max
      FROM (SELECT *, p99 > p01 AND least(180, p99) > greatest(10, p01) AS ok FROM (
        SELECT date, quantile_cont(y_pred, 0.01) AS p01, quantile_cont(y_pred, 0.99) AS p99 FROM predictions GROUP BY 1))""",
    doubles="vmin vmax period_min period_max",
)
def _(lake):
    return grids.frame_scale(lake.predictions(), 10.0, 180.0, "y_pred")


def metric_sql(y: str = "y_true", p: str = "y_pred") -> str:
    e = f"({p} - {y})"
    return f"""sqrt(avg({e}*{e})) AS rmse, avg(abs{e}) AS mae, 1 - sum({e}*{e})/nullif(var_pop({y})*count({y}), 0) AS r2, avg{e} AS bias,
      CASE WHEN count(CASE WHEN {y} >= 150 THEN 1 END) = 0 THEN 0 ELSE 2.0::DOUBLE*count(CASE WHEN {y} >= 150 AND {p} >= 150 THEN 1 END)
        /(count(CASE WHEN {y} >= 150 THEN 1 END) + count(CASE WHEN {p} >= 150 THEN 1 END)) END AS f1_150,
      sqrt(avg(CASE WHEN {y} >= 150 THEN {e}*{e} END)) AS extreme_rmse, count(CASE WHEN {y} >= 150 THEN 1 END) AS n_extreme_true,
      count(CASE WHEN {p} >= 150 THEN 1 END) AS n_extreme_pred, count({y}) AS n_predictions"""


METRIC_DOUBLES = "rmse mae r2 bias f1_150 extreme_rmse"
_SEASON = """CASE WHEN month IN (12,1,2) THEN 'winter' WHEN month IN (3,4,5) THEN 'pre_monsoon' WHEN month BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END"""


@query("evaluate_predictions", f"SELECT {metric_sql()} FROM predictions", doubles=METRIC_DOUBLES)
def _(lake):
    return evaluate.evaluate_predictions(lake.predictions())


@query(
    "metrics_by_month",
    f"""SELECT 'overall' AS scope, 'all' AS key, {metric_sql()} FROM predictions UNION ALL
      SELECT 'month', month::VARCHAR, {metric_sql()} FROM predictions GROUP BY month UNION ALL
      SELECT 'season', {_SEASON} AS s, {metric_sql()} FROM predictions GROUP BY s""",
    doubles=METRIC_DOUBLES,
)
def _(lake):
    return evaluate.metrics_by_period(lake.predictions())


@query("metrics_by_season", f"SELECT {_SEASON} AS season, {metric_sql()} FROM predictions GROUP BY 1", doubles=METRIC_DOUBLES)
def _(lake):
    p = lake.predictions()
    return evaluate.evaluate_predictions(p, [season_label(F.col("month")).alias("season")])


@query(
    "metrics_by_province",
    f"SELECT s.province, {metric_sql()}, count(DISTINCT p.sensor_id) AS n_stations FROM predictions p JOIN stations s USING (sensor_id) GROUP BY 1",
    doubles=METRIC_DOUBLES,
)
def _(lake):
    rows = lake.predictions().join(lake.stations().select("sensor_id", "province"), "sensor_id")
    return evaluate.evaluate_predictions(rows, ["province"], extra=[F.countDistinct("sensor_id").alias("n_stations")])


_BY_STATION = f"SELECT sensor_id, {metric_sql()} FROM predictions GROUP BY 1 HAVING count(y_true) >= 30"


@query("metrics_by_station", _BY_STATION, doubles=METRIC_DOUBLES)
def _(lake):
    return evaluate.metrics_by_station(lake.predictions())


@query(
    "metric_distribution",
    f"""SELECT avg(mae) AS mean, max(mae) AS worst, count(mae) AS n_stations, median(mae) AS median, quantile_cont(mae, 0.1) AS p10, quantile_cont(mae, 0.9) AS p90 FROM ({_BY_STATION})""",
    doubles="mean worst median p10 p90",
)
def _(lake):
    return evaluate.metric_distribution(evaluate.metrics_by_station(lake.predictions()))


_SKILL = """WITH train AS (SELECT sensor_id, date, pm25 FROM skill_daily WHERE is_train), t AS (SELECT sensor_id, date, pm25 FROM skill_daily WHERE NOT is_train),
  b AS (SELECT t.sensor_id, t.date, t.pm25 AS y, p.pm25 AS per, coalesce(o.m, g.m, (SELECT median(pm25) FROM train)) AS cl,
    (SELECT avg(pm25) FROM train) AS f FROM t LEFT JOIN (SELECT sensor_id, date, min(pm25) AS pm25 FROM skill_daily GROUP BY 1, 2) p ON p.sensor_id = t.sensor_id AND p.date = t.date - 1
    LEFT JOIN (SELECT sensor_id, month(date) AS mo, median(pm25) AS m FROM train GROUP BY 1, 2) o ON o.sensor_id = t.sensor_id AND o.mo = month(t.date)
    LEFT JOIN (SELECT month(date) AS mo, median(pm25) AS m FROM train GROUP BY 1) g ON g.mo = month(t.date)),
  s AS (SELECT *, 0.5*f + 0.5*coalesce(per, f) AS q, CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'pre_monsoon'
    WHEN month(date) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season FROM b)
  SELECT *, 1 - mae/nullif(mae_persistence, 0) AS mae_skill_persistence, 1 - rmse/nullif(rmse_persistence, 0) AS rmse_skill_persistence,
    1 - mae/nullif(mae_climatology, 0) AS mae_skill_climatology, 1 - rmse/nullif(rmse_climatology, 0) AS rmse_skill_climatology FROM (
    SELECT season, count(*) AS n, avg(abs(q - y)) AS mae, sqrt(avg(pow(q - y, 2))) AS rmse, avg(abs(per - y)) AS mae_persistence,
      sqrt(avg(pow(per - y, 2))) AS rmse_persistence, count(per - y) AS n_persistence, avg(abs(cl - y)) AS mae_climatology,
      sqrt(avg(pow(cl - y, 2))) AS rmse_climatology, count(cl - y) AS n_climatology FROM s GROUP BY 1)"""
_SKILL_DOUBLES = " ".join(
    f"{m}{x}" for m in ("mae", "rmse") for x in ("", "_persistence", "_climatology", "_skill_persistence", "_skill_climatology")
)


def skill_rows(lake):
    """Held-out days with both references and a forecast halfway between mean and persistence."""
    rows = lake.skill_daily()
    train = rows.where("is_train").drop("is_train")
    test = rows.where("NOT is_train").drop("is_train")
    both = evaluate.with_baselines(test, train, rows)
    mean = train.agg(F.avg("pm25")).scalar()
    return both.withColumn("_mean", mean).select(
        "sensor_id",
        "date",
        "month",
        F.col("pm25").alias("y_true"),
        "persistence",
        "climatology",
        (0.5 * F.col("_mean") + 0.5 * F.coalesce("persistence", "_mean")).alias("y_pred"),
    )


@query("skill_score", _SKILL, doubles=_SKILL_DOUBLES)
def _(lake):
    rows = skill_rows(lake).withColumn("season", season_label(F.col("month")))
    return evaluate.skill_against(rows, ["persistence", "climatology"], ["season"])


@query(
    "common_support_eval",
    f"""WITH r AS (SELECT y_true, y_pred, CASE WHEN y_true < 120 THEN y_true*0.9 END AS other FROM predictions), c AS (SELECT * FROM r WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND other IS NOT NULL)
      SELECT 'y_pred' AS model, {metric_sql()} FROM c UNION ALL SELECT 'other', {metric_sql(p="other")} FROM c""",
    doubles=METRIC_DOUBLES,
)
def _(lake):
    p = lake.predictions().withColumn("other", F.when(F.col("y_true") < 120, F.col("y_true") * 0.9))
    return evaluate.common_support_eval(p, ["y_pred", "other"])


@query(
    "cv_aggregate",
    f"""WITH f AS (SELECT event_id % 5 AS fold, {metric_sql()} FROM predictions GROUP BY 1)
      SELECT UNNEST(['rmse','mae','bias']) AS metric, UNNEST([avg(rmse), avg(mae), avg(bias)]) AS mean, UNNEST([stddev_pop(rmse), stddev_pop(mae), stddev_pop(bias)]) AS std FROM f""",
    doubles="mean std",
)
def _(lake):
    folds = evaluate.evaluate_predictions(lake.predictions(), [(F.col("event_id") % 5).alias("fold")])
    return evaluate.cv_aggregate(folds, ["rmse", "mae", "bias"])


@query(
    "station_month_median",
    "SELECT sensor_id, month(date)::INTEGER AS month, median(pm25) AS median FROM yearly GROUP BY 1, 2",
    doubles="median",
)
def _(lake):
    return evaluate.station_month_median(lake.yearly())


@query(
    "coverage_by_province",
    """SELECT s.province, count(*) AS n, 100*avg((coalesce(WS10, RH) IS NOT NULL)::INTEGER) AS wind_available_pct,
      100*avg((d2m IS NOT NULL)::INTEGER) AS dew_available_pct, avg(WS10) AS mean_WS10, avg(d2m) AS mean_d2m FROM met_readings JOIN stations s USING (sensor_id) GROUP BY 1""",
    doubles="wind_available_pct dew_available_pct mean_WS10 mean_d2m",
)
def _(lake):
    rows = lake.met_readings().join(lake.stations().select("sensor_id", "province"), "sensor_id")
    return stations.coverage_by_province(rows, {"wind": ["WS10", "RH"], "dew": ["d2m"]}, ["WS10", "d2m"])


_OFFSETS = "SELECT date, count(*) AS n, CASE WHEN count(*) >= 3 THEN median(y_true - y_pred) ELSE 0 END AS day_offset FROM predictions GROUP BY 1"


@query("daily_offset_fit", _OFFSETS, doubles="day_offset")
def _(lake):
    return calibrate.daily_offset_fit(lake.predictions())


@query(
    "daily_offset_apply",
    f"SELECT p.event_id, p.y_pred + coalesce(o.day_offset, 0) AS calibrated FROM predictions p LEFT JOIN ({_OFFSETS}) o USING (date)",
    doubles="calibrated",
)
def _(lake):
    p = lake.predictions()
    return calibrate.daily_offset_apply(p, calibrate.daily_offset_fit(p)).select("event_id", "calibrated")


@query(
    "daily_line_fit",
    "SELECT date, count(*) AS n, regr_slope(y_true, y_pred) AS slope, regr_intercept(y_true, y_pred) AS intercept FROM predictions GROUP BY 1",
    doubles="slope intercept",
)
def _(lake):
    return calibrate.daily_line_fit(lake.predictions())


def _huber_sql(steps: int) -> str:
    """The robust lines after so many steps, each a common table expression of its own."""
    parts = [
        "h AS (SELECT date, y_true AS y, y_pred AS x FROM predictions WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)",
        """l0 AS MATERIALIZED (SELECT date, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, stddev_pop(y) AS s, count(*) AS n FROM h GROUP BY 1)""",
    ]
    for i in range(steps):
        parts.append(
            f"""l{i + 1} AS MATERIALIZED (SELECT date, a, (sy - a*sx)/sw AS b, greatest(sqrt(r2/greatest(n - out*1.8225::DOUBLE, 1)), 1e-9) AS s, n FROM (
            SELECT *, (sw*sxy - sx*sy)/nullif(sw*sxx - sx*sx, 0) AS a FROM (
            SELECT date, sum(w) AS sw, sum(w*x) AS sx, sum(w*y) AS sy, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, count(*) AS n,
              sum((r > t)::INTEGER) AS out, sum(CASE WHEN r > t THEN 0 ELSE r*r END) AS r2 FROM (
            SELECT *, CASE WHEN r > t THEN t/r ELSE 1 END AS w FROM (
            SELECT h.date, x, y, abs(y - a*x - b) AS r, s*1.35::DOUBLE AS t FROM h JOIN l{i} USING (date))) GROUP BY 1)))"""
        )
    return f"""WITH {", ".join(parts)} SELECT date, n, CASE WHEN n >= 5 AND a IS NOT NULL THEN a ELSE 1 END AS slope,
      CASE WHEN n >= 5 AND a IS NOT NULL THEN b ELSE 0 END AS intercept FROM l{steps}"""


_LINES = _huber_sql(40)


@query("daily_affine_fit", _LINES, doubles="slope intercept", digits=4)
def _(lake):
    return calibrate.daily_affine_fit(lake.predictions()).drop("converged")


@query(
    "daily_affine_apply",
    f"SELECT event_id, coalesce(slope, 1)*y_pred + coalesce(intercept, 0) AS calibrated FROM predictions LEFT JOIN ({_LINES}) USING (date)",
    doubles="calibrated",
    digits=4,
)
def _(lake):
    p = lake.predictions()
    return calibrate.daily_affine_apply(p, calibrate.daily_affine_fit(p)).select("event_id", "calibrated")


@query(
    "total_variation",
    """SELECT c.date, coalesce(avg(abs(r.value - c.value)), 0) + coalesce(avg(abs(d.value - c.value)), 0) AS total_variation,
      count(r.value) AS n_horizontal, count(d.value) AS n_vertical FROM met_cube c LEFT JOIN met_cube r ON r.date = c.date AND r.iy = c.iy AND r.ix = c.ix + 1
      LEFT JOIN met_cube d ON d.date = c.date AND d.iy = c.iy + 1 AND d.ix = c.ix GROUP BY 1""",
    doubles="total_variation",
)
def _(lake):
    return grids.total_variation(lake.met_cube().withColumnsRenamed({"iy": "prow", "ix": "pcol"}))


@query(
    "balanced_weights",
    """WITH r AS (SELECT d.sensor_id, d.date, s.province FROM station_daily d JOIN stations s USING (sensor_id)),
      w AS (SELECT *, 1/sqrt(count(*) OVER (PARTITION BY province))*(1/sqrt(count(*) OVER (PARTITION BY province, sensor_id))) AS w FROM r),
      c AS (SELECT *, least(w, (SELECT quantile_cont(w, 0.99) FROM w)) AS cw FROM w)
      SELECT sensor_id, date, province, cw/(SELECT avg(cw) FROM c) AS weight FROM c""",
    doubles="weight",
)
def _(lake):
    rows = lake.station_daily().select("sensor_id", "date").join(lake.stations().select("sensor_id", "province"), "sensor_id")
    return stations.balanced_weights(rows)


@query(
    "in_country_mean",
    "SELECT date, avg(value) AS mean, count(value) AS n_cells FROM met_cube WHERE iy BETWEEN 2 AND 8 AND ix BETWEEN 3 AND 10 GROUP BY 1",
    doubles="mean",
)
def _(lake):
    inside = F.col("iy").between(2, 8) & F.col("ix").between(3, 10)
    return grids.in_country_mean(lake.met_cube().withColumn("inside", inside), "inside", "value")


@query(
    "feature_grid_diagnostics",
    """WITH c AS (SELECT * FROM met_cube), g AS (SELECT c.date, c.iy, c.ix, sum((CASE o.dc WHEN 0 THEN 0 ELSE o.dc*(2-abs(o.dr)) END)*n.value) AS gx,
        sum((CASE o.dr WHEN 0 THEN 0 ELSE o.dr*(2-abs(o.dc)) END)*n.value) AS gy, count(n.value) AS k FROM c
        CROSS JOIN (SELECT dr, dc FROM (VALUES (-1),(0),(1)) a(dr), (VALUES (-1),(0),(1)) b(dc) WHERE NOT (dr = 0 AND dc = 0)) o
        JOIN met_cube n ON n.date = c.date AND n.iy = c.iy + o.dr AND n.ix = c.ix + o.dc WHERE c.iy BETWEEN 1 AND 9 AND c.ix BETWEEN 1 AND 11 GROUP BY 1, 2, 3),
      h AS (SELECT date, string_agg(b || ':' || n, ',' ORDER BY b) AS histogram FROM (SELECT date, CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 11 ELSE floor(value/20)::INTEGER + 1 END AS b, count(*) AS n FROM met_cube GROUP BY 1, 2) GROUP BY 1)
      SELECT s.*, h.histogram, e.edge_strength FROM (SELECT date, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM met_cube GROUP BY 1) s LEFT JOIN h USING (date)
      LEFT JOIN (SELECT date, avg(sqrt(gx*gx + gy*gy)) AS edge_strength FROM g WHERE k = 8 AND EXISTS (SELECT 1 FROM met_cube m WHERE m.date = g.date AND m.iy = g.iy AND m.ix = g.ix) GROUP BY 1) e USING (date)""",
    doubles="mean std edge_strength",
)
def _(lake):
    grid = lake.met_cube().withColumnsRenamed({"iy": "prow", "ix": "pcol"})
    return grids.feature_grid_diagnostics(grid, ["date"], "value", 0.0, 200.0, 10, 11, 13)


@query(
    "representative_day",
    """WITH d AS (SELECT date, CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'pre_monsoon' WHEN month(date) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season,
        avg(pm25) AS mean FROM skill_daily GROUP BY 1, 2 HAVING avg(pm25) IS NOT NULL)
      SELECT season, date, mean FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY mean, date) - 1 AS r, count(*) OVER (PARTITION BY season) AS n FROM d)
      WHERE r = round_even((CASE season WHEN 'winter' THEN 0.8 WHEN 'pre_monsoon' THEN 0.5 WHEN 'monsoon' THEN 0.2 ELSE 0.6 END)::DOUBLE*(n - 1), 0)""",
    doubles="mean",
)
def _(lake):
    days = lake.skill_daily().groupBy("date").agg(F.avg("pm25").alias("mean"))
    days = days.withColumn("season", season_label(F.month("date")))
    return grids.representative_day(days, {"winter": 80, "pre_monsoon": 50, "monsoon": 20, "post_monsoon": 60})


@query(
    "registry_summary",
    """SELECT p_type AS stage, count(CASE WHEN p_size > 10 THEN 1 END) AS feature, count(CASE WHEN p_size <= 10 THEN 1 END) AS metadata FROM part GROUP BY 1""",
)
def _(lake):
    reg = lake.table("part").select(
        F.col("p_type").alias("stage"), F.when(F.col("p_size") > 10, "feature").otherwise("metadata").alias("category")
    )
    return assemble.registry_summary(reg, ["feature", "metadata"])


