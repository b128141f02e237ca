"""Registered queries: gap-aware station windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, stations, temporal
from ..operators.temporal import LEVEL2_SPECS, Anomaly, Lag, Roll
from .registry import query


def _segmented(source: str, gap: float = 2) -> str:
    return f"""SELECT *, sum(starts) OVER (PARTITION BY sensor_id ORDER BY date) AS segment FROM (
      SELECT *, CASE WHEN lag(date) OVER (PARTITION BY sensor_id ORDER BY date) IS NULL
        OR date - lag(date) OVER (PARTITION BY sensor_id ORDER BY date) > {gap} THEN 1 ELSE 0 END AS starts FROM {source})"""


_W = "(PARTITION BY sensor_id, segment ORDER BY date"
_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def _roll(col: str, stat: str, n: int, least: int | None = None) -> str:
    frame = f"{_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    least = max(1, n // 2) if least is None else least
    return f"CASE WHEN count({col}) OVER {frame} >= {least} THEN {_AGG[stat]}({col}) OVER {frame} END"


def _spec_sql(s) -> str:
    if isinstance(s, Lag):
        return f"lag({s.source}, {s.days}) OVER {_W}) AS {s.name}"
    if isinstance(s, Roll):
        return f"{_roll(s.source, s.stat, s.days)} AS {s.name}"
    return f"{s.source} - {_roll(s.source, 'mean', s.days)} AS {s.name}"


@query("time_segments", f"SELECT sensor_id, date, segment::BIGINT AS segment FROM ({_segmented('sparse_daily')})")
def _(lake):
    return temporal.time_segments(lake.sparse_daily()).select("sensor_id", "date", "segment")


@query(
    "gap_days",
    "SELECT sensor_id, date, (date - lag(date) OVER (PARTITION BY sensor_id ORDER BY date))::DOUBLE AS dt_days FROM sparse_daily",
    doubles="dt_days",
)
def _(lake):
    return temporal.gap_days(lake.sparse_daily()).select("sensor_id", "date", "dt_days")


_LAGS = [Lag("WS10", 1), Lag("WS10", 3), Lag("blh", 1), Lag("blh", 3)]


@query(
    "segment_lag",
    f"SELECT sensor_id, date, {', '.join(map(_spec_sql, _LAGS))} FROM ({_segmented('met_daily')})",
    doubles=" ".join(s.name for s in _LAGS),
)
def _(lake):
    out = temporal.segment_lag(temporal.time_segments(lake.met_daily()), ["WS10", "blh"], [1, 3])
    return out.select("sensor_id", "date", *[s.name for s in _LAGS])


_ROLLS = [Roll("pm25", stat, n) for n in (3, 7) for stat in ("mean", "std", "min", "max", "sum")]


@query(
    "segment_rolling",
    f"SELECT sensor_id, date, {', '.join(map(_spec_sql, _ROLLS))} FROM ({_segmented('sparse_daily')})",
    doubles=" ".join(s.name for s in _ROLLS),
)
def _(lake):
    out = temporal.segment_rolling(temporal.time_segments(lake.sparse_daily()), _ROLLS)
    return out.select("sensor_id", "date", *[s.name for s in _ROLLS])


@query(
    "gap_safe_rolling",
    f"SELECT sensor_id, date, {_roll('pm25', 'mean', 5, 1)} AS pm25_roll_mean_5d FROM ({_segmented('sparse_daily', 1)})",
    doubles="pm25_roll_mean_5d",
)
def _(lake):
    out = temporal.gap_safe_rolling(lake.sparse_daily(), ["sensor_id"], "date", ["pm25"], 5)
    return out.select("sensor_id", "date", "pm25_roll_mean_5d")


_ANOMS = [Anomaly(c, n) for c, n in (("blh", 7), ("blh", 14), ("RH", 7), ("VC", 7), ("VC", 14))]


@query(
    "rolling_anomaly",
    f"SELECT sensor_id, date, {', '.join(map(_spec_sql, _ANOMS))} FROM ({_segmented('met_daily')})",
    doubles=" ".join(s.name for s in _ANOMS),
)
def _(lake):
    out = temporal.rolling_anomaly(temporal.time_segments(lake.met_daily()), _ANOMS)
    return out.select("sensor_id", "date", *[s.name for s in _ANOMS])


def _events_sql(prefix: str, cond: str) -> str:
    flagged = f"SELECT *, coalesce({cond}, false)::INTEGER AS hit FROM ({_segmented('met_daily')})"
    counts = f"SELECT *, {_roll('hit', 'sum', 3)} AS c3, {_roll('hit', 'sum', 7)} AS c7 FROM ({flagged})"
    return f"""SELECT sensor_id, date, c3::BIGINT AS {prefix}3_count, coalesce(c3 >= 2, false)::INTEGER AS {prefix}3_flag,
      c7::BIGINT AS {prefix}7_count, coalesce(c7 >= 5, false)::INTEGER AS {prefix}7_flag FROM ({counts})"""


def _event_columns(prefix: str) -> list[str]:
    return ["sensor_id", "date", *[f"{prefix}{n}_{k}" for n in (3, 7) for k in ("count", "flag")]]


@query("calm_counts", _events_sql("calm", "WS10 < 2"))
def _(lake):
    seg = temporal.time_segments(lake.met_daily())
    return temporal.calm_counts(seg, temporal.within_segment()).select(*_event_columns("calm"))


@query("stagnation_counts", _events_sql("stagnant", "WS10 < 2 AND blh < 300"))
def _(lake):
    seg = temporal.time_segments(lake.met_daily())
    return temporal.stagnation_counts(seg, temporal.within_segment()).select(*_event_columns("stagnant"))


_WD = "SELECT *, sin(radians(WD10)) AS s, cos(radians(WD10)) AS c FROM (" + _segmented("met_daily") + ")"
_WDM = (
    f"SELECT sensor_id, date, s AS WD10_sin, c AS WD10_cos, {_roll('s', 'mean', 7)} AS WD10_sin_rm_7d, {_roll('c', 'mean', 7)} AS WD10_cos_rm_7d, "
    f"{_roll('s', 'mean', 14)} AS WD10_sin_rm_14d, {_roll('c', 'mean', 14)} AS WD10_cos_rm_14d FROM ({_WD})"
)
_WD_COLS = ["WD10_sin", "WD10_cos"] + [f"WD10_{k}_{n}d" for n in (7, 14) for k in ("sin_rm", "cos_rm", "var")]


def _var(n):
    r = f"1 - sqrt(pow(WD10_sin_rm_{n}d, 2) + pow(WD10_cos_rm_{n}d, 2))"
    return f"CASE WHEN {r} < 0 THEN 0 WHEN {r} > 1 THEN 1 ELSE {r} END AS WD10_var_{n}d"


@query("wind_direction_variance", f"SELECT *, {_var(7)}, {_var(14)} FROM ({_WDM})", doubles=" ".join(_WD_COLS))
def _(lake):
    seg = temporal.time_segments(lake.met_daily())
    return temporal.wind_direction_variance(seg, temporal.within_segment()).select("sensor_id", "date", *_WD_COLS)


_TEND = [s for s in LEVEL2_SPECS if s.source in ("BLH_tend", "MSLP_tend", "SP_tend", "dT", "dWS", "dWD")]


@query(
    "tendency_rolls",
    f"SELECT sensor_id, date, abs(dWS) AS dWS_abs, abs(dWD) AS dWD_abs, {', '.join(map(_spec_sql, _TEND))} FROM ({_segmented('met_daily')})",
    doubles="dWS_abs dWD_abs " + " ".join(s.name for s in _TEND),
)
def _(lake):
    seg = temporal.time_segments(lake.met_daily())
    out = temporal.tendency_rolls(seg, temporal.within_segment())
    return out.select("sensor_id", "date", "dWS_abs", "dWD_abs", *[s.name for s in _TEND])


_L2_NAMES = [s.name for s in LEVEL2_SPECS]


@query(
    "met_level2",
    f"""SELECT sensor_id, date, (date - lag(date) OVER (PARTITION BY sensor_id ORDER BY date))::DOUBLE AS dt_days,
      month(date)::INTEGER AS month, (month(date) IN (11,12,1,2))::INTEGER AS heating_season_flag,
      {', '.join(map(_spec_sql, LEVEL2_SPECS))}, {_roll('calm', 'sum', 7)}::BIGINT AS calm7_count,
      {_roll('still', 'sum', 3)}::BIGINT AS stagnant3_count
    FROM (SELECT *, coalesce(WS10 < 2, false)::INTEGER AS calm, coalesce(WS10 < 2 AND blh < 300, false)::INTEGER AS still
      FROM ({_segmented('met_daily')}))""",
    doubles="dt_days " + " ".join(_L2_NAMES),
)
def _(lake):
    out = temporal.met_level2(lake.met_daily())
    return out.select(
        "sensor_id", "date", "dt_days", "month", "heating_season_flag", *_L2_NAMES, "calm7_count", "stagnant3_count"
    )


_HOURLY = """SELECT user_id AS sensor_id, date_trunc('hour', ts) AS hour, avg(value) AS pm25 FROM events GROUP BY 1, 2"""


@query(
    "causal_tendency",
    f"""SELECT sensor_id, hour, (s - lag(s) OVER w)/(epoch(hour - lag(hour) OVER w)/3600.0) AS tendency FROM (
      SELECT *, avg(pm25) OVER (PARTITION BY sensor_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM ({_HOURLY}))
      WINDOW w AS (PARTITION BY sensor_id ORDER BY hour)""",
    doubles="tendency",
)
def _(lake):
    hourly = stations.hourly_readings(lake.readings())
    out = temporal.causal_tendency(hourly, "pm25", "sensor_id", "hour", "tendency")
    return out.select("sensor_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "tendency")


@query(
    "day_difference",
    """SELECT sensor_id, date, blh - lag(blh) OVER w AS blh_diff, sp - lag(sp) OVER w AS sp_diff FROM met_daily
    WINDOW w AS (PARTITION BY sensor_id ORDER BY date)""",
    doubles="blh_diff sp_diff",
)
def _(lake):
    return temporal.day_difference(lake.met_daily(), ["blh", "sp"]).select("sensor_id", "date", "blh_diff", "sp_diff")


@query(
    "forward_fill",
    """SELECT sensor_id, date, last_value(BLH_tend IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BLH_tend FROM met_daily""",
    doubles="BLH_tend",
)
def _(lake):
    return temporal.forward_fill(lake.met_daily(), ["BLH_tend"]).select("sensor_id", "date", "BLH_tend")


_HISTORY_TENDENCIES = ("BLH_tend", "MSLP_tend", "SP_tend", "dT")
_SLICED = """(SELECT m.* REPLACE (m.sensor_id || '@' || d.day AS sensor_id), m.sensor_id AS sensor, d.day FROM met_daily m
      JOIN (SELECT UNNEST(generate_series(TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-30', INTERVAL 1 DAY))::DATE AS day) d
      ON m.date BETWEEN d.day - 21 AND d.day)"""


@query(
    "history_slice",
    f"""SELECT sensor AS sensor_id, date, {_roll('WS10', 'mean', 3, 2)} AS WS10_rollmean_3d, {_roll('WS10', 'max', 7, 4)} AS WS10_rollmax_7d, {_roll('blh', 'mean', 14, 7)} AS blh_rollmean_14d,
      lag(WS10, 3) OVER {_W}) AS WS10_lag3d, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY date) AS {c}" for c in _HISTORY_TENDENCIES)}
      FROM ({_segmented(_SLICED)}) QUALIFY date = day""",
    doubles="WS10_rollmean_3d WS10_rollmax_7d blh_rollmean_14d WS10_lag3d " + " ".join(_HISTORY_TENDENCIES),
)
def _(lake):
    out = temporal.history_features(lake.met_daily(), "2024-01-22", "2024-01-30")
    return out.select(
        "sensor_id", "date", "WS10_rollmean_3d", "WS10_rollmax_7d", "blh_rollmean_14d", "WS10_lag3d", *_HISTORY_TENDENCIES
    )


@query(
    "target_lags",
    "SELECT sensor_id, date, " + ", ".join(f"lag(pm25, {k}) OVER w AS pm25_lag{k}" for k in (1, 2, 3, 7))
    + " FROM station_daily WINDOW w AS (PARTITION BY sensor_id ORDER BY date)",
    doubles="pm25_lag1 pm25_lag2 pm25_lag3 pm25_lag7",
)
def _(lake):
    return temporal.target_lags(lake.station_daily()).drop("pm25", "n")


def _before(n, f, least):
    fr = f"OVER (PARTITION BY sensor_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(pm25) {fr} >= {least} THEN {f}(pm25) {fr} END"


@query(
    "target_rolls",
    f"""SELECT sensor_id, date, {_before(3, 'avg', 1)} AS pm25_rollmean_3, {_before(7, 'avg', 1)} AS pm25_rollmean_7,
    {_before(3, 'stddev_samp', 2)} AS pm25_rollstd_3 FROM station_daily""",
    doubles="pm25_rollmean_3 pm25_rollmean_7 pm25_rollstd_3",
)
def _(lake):
    return temporal.target_rolls(lake.station_daily()).drop("pm25", "n")


@query(
    "nearest_time",
    """SELECT sensor_id, date, ts, value AS pm25 FROM (SELECT user_id AS sensor_id, CAST(ts AS DATE) AS date, ts, value,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY abs(epoch_us(ts) - epoch_us(date_trunc('day', ts) + INTERVAL 12 HOUR)), ts) AS rn
      FROM events) WHERE rn = 1""",
    doubles="pm25",
)
def _(lake):
    rows = lake.readings().withColumn("date", F.to_date("ts"))
    noon = F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")
    out = temporal.nearest_time(rows, ["sensor_id", "date"], "ts", noon, ["pm25"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "daily_midnight_snapshot",
    f"""WITH h AS ({_HOURLY}), s AS (SELECT *, lead(hour) OVER w AS t1, lead(pm25) OVER w AS v1, lag(hour) OVER w AS tp FROM h
        WINDOW w AS (PARTITION BY sensor_id ORDER BY hour)),
      d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)
      SELECT sensor_id, date, pm25 + (v1 - pm25)*(epoch(date::TIMESTAMP - hour)/epoch(t1 - hour)) AS pm25
        FROM s JOIN d ON date::TIMESTAMP >= hour AND date::TIMESTAMP < t1
      UNION ALL SELECT sensor_id, CAST(hour AS DATE), pm25 FROM s WHERE tp IS NULL AND hour > date_trunc('day', hour)
      UNION ALL SELECT sensor_id, CAST(hour AS DATE), pm25 FROM s WHERE t1 IS NULL AND hour = date_trunc('day', hour)""",
    doubles="pm25",
)
def _(lake):
    return grids.daily_midnight_snapshot(stations.hourly_readings(lake.readings()), "sensor_id", "hour", "pm25")


_SITES = "SELECT sensor_id, lat, lon FROM stations"


@query(
    "monitor_history_block",
    f"""WITH p AS (SELECT a.sensor_id AS a, b.sensor_id AS b FROM stations a JOIN stations b ON a.sensor_id <> b.sensor_id
        AND 2*6371.0*asin(least(1, sqrt(pow(sin(radians(b.lat-a.lat)/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) <= 150),
      near AS (SELECT p.a AS sensor_id, d.date, avg(d.pm25) AS v, count(d.pm25) AS n FROM p JOIN station_daily d ON d.sensor_id = p.b GROUP BY 1, 2)
      SELECT t.sensor_id, t.date, {", ".join(f"o{k}.pm25 AS pm25_own_lag{k}, n{k}.v AS pm25_near_lag{k}" for k in (1, 2, 3))},
        n1.n AS n_near_lag1 FROM station_daily t
      {" ".join(f"LEFT JOIN station_daily o{k} ON o{k}.sensor_id = t.sensor_id AND o{k}.date = t.date - {k} LEFT JOIN near n{k} ON n{k}.sensor_id = t.sensor_id AND n{k}.date = t.date - {k}" for k in (1, 2, 3))}""",
    doubles=" ".join(f"pm25_own_lag{k} pm25_near_lag{k}" for k in (1, 2, 3)),
)
def _(lake):
    return stations.monitor_history(lake.station_daily(), lake.stations(), 150.0).drop("pm25", "n")
