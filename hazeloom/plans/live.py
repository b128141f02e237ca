"""Registered queries: streaming operators driven by the events file to completion."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators.temporal import Lag, Roll
from ..session import scratch_path
from ..streaming import rolling, streams
from .registry import query

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_WATERMARK = "(SELECT max(ts) FROM events)"


def _live(lake):
    """The events file as a stream of readings."""
    schema = lake.table("events").schema
    raw = lake.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(lake.folder)
    return raw.select(
        F.col("user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("pm25"), "event_type"
    )


@contextmanager
def _rocksdb(spark):
    """The state store that transformWithState needs, while a stream starts; later queries keep the session's own."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, streams.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def _run(lake, rows, name):
    base = scratch_path(lake.spark, name)
    return streams.run_to_table(rows, f"{base}/table", f"{base}/checkpoint")


@query(
    "stream_hourly_to_daily",
    f"""SELECT sensor_id, CAST(hour AS DATE) AS date, avg(pm25) AS pm25_mean, count(*) AS n_hours_valid, (count(*) >= 3)::INTEGER AS complete FROM (
      SELECT user_id AS sensor_id, date_trunc('hour', ts) AS hour, avg(value) AS pm25 FROM events GROUP BY 1, 2) GROUP BY 1, 2
      HAVING CAST(hour AS DATE)::TIMESTAMP + INTERVAL 1 DAY <= {_WATERMARK} - INTERVAL 6 HOUR""",
    doubles="pm25_mean",
)
def _(lake):
    return _run(lake, streams.stream_hourly_to_daily(_live(lake), min_hours=3), "daily")


@query(
    "stream_segments",
    f"""WITH e AS (SELECT user_id AS sensor_id, value, ts + INTERVAL 1 DAY * ((day(ts) + user_id)//4 * (user_id % 4)) AS ts FROM events),
      g AS (SELECT sensor_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 DAY THEN 0 ELSE 1 END AS s FROM e
        WINDOW w AS (PARTITION BY sensor_id ORDER BY ts)),
      i AS (SELECT *, sum(s) OVER (PARTITION BY sensor_id ORDER BY ts) AS seg FROM g)
      SELECT sensor_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, avg(value) AS pm25_mean FROM i GROUP BY sensor_id, seg
      HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM e) - INTERVAL 6 HOUR""",
    doubles="pm25_mean",
)
def _(lake):
    # pulled apart as in Lake.sparse_daily, so that there are gaps to find
    days = ((F.day("ts") + F.col("sensor_id")) / 4).cast("int") * (F.col("sensor_id") % 4).cast("int")
    sparse = _live(lake).withColumn("ts", F.col("ts") + F.make_dt_interval(days))
    out = _run(lake, streams.stream_segments(sparse), "segments")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@query(
    "stream_store_sink",
    "SELECT CAST(ts AS DATE) AS date, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1",
    doubles="mean",
)
def _(lake):
    base = scratch_path(lake.spark, "sink")
    rows = _live(lake).withColumn("date", F.to_date("ts"))
    streams.stream_store_sink(rows, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    stored = lake.spark.read.parquet(f"{base}/table")
    return stored.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "stream_lag_features",
    """SELECT a.sensor_id, a.date, a.pm25, b.pm25 AS pm25_lag1 FROM station_daily a
    LEFT JOIN station_daily b ON b.sensor_id = a.sensor_id AND b.date = a.date - 1
    WHERE a.date + 1 <= (SELECT max(date) FROM station_daily) - 10""",
    doubles="pm25 pm25_lag1",
)
def _(lake):
    store = lake.store()
    schema = store.read("station").schema
    # the stored days arrive twice, as a resent file would
    raw = lake.spark.readStream.schema(schema).parquet(store.path("station"))
    daily = raw.select("sensor_id", F.col("date").cast("timestamp").alias("ts"), "pm25")
    with _rocksdb(lake.spark):
        return _run(lake, streams.stream_lag_features(daily.union(daily)), "lags")


_SPECS = [Lag("pm25", 1), Lag("pm25", 3), Roll("pm25", "mean", 3), Roll("pm25", "std", 7), Roll("pm25", "max", 14)]


def _rolled(f, n):
    frame = f"OVER (PARTITION BY sensor_id, seg ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(pm25) {frame} >= {max(1, n // 2)} THEN {f}(pm25) {frame} END"


@query(
    "stream_rolling_features",
    f"""WITH g AS (SELECT sensor_id, date, pm25, CASE WHEN date - lag(date) OVER (PARTITION BY sensor_id ORDER BY date) <= 2 THEN 0 ELSE 1 END AS s FROM sparse_daily),
      i AS (SELECT *, sum(s) OVER (PARTITION BY sensor_id ORDER BY date) AS seg FROM g)
      SELECT sensor_id, date, pm25, lag(pm25, 1) OVER w AS pm25_lag1d, lag(pm25, 3) OVER w AS pm25_lag3d, {_rolled('avg', 3)} AS pm25_rollmean_3d,
        {_rolled('stddev_samp', 7)} AS pm25_rollstd_7d, {_rolled('max', 14)} AS pm25_rollmax_14d FROM i WINDOW w AS (PARTITION BY sensor_id, seg ORDER BY date)
      QUALIFY date + 1 <= (SELECT max(date) FROM sparse_daily) - 10""",
    doubles="pm25 pm25_lag1d pm25_lag3d pm25_rollmean_3d pm25_rollstd_7d pm25_rollmax_14d",
)
def _(lake):
    path = scratch_path(lake.spark, "days")
    lake.sparse_daily().select("sensor_id", F.col("date").cast("timestamp").alias("ts"), "pm25").write.parquet(path)
    daily = lake.spark.readStream.schema("sensor_id bigint, ts timestamp, pm25 double").parquet(path)
    with _rocksdb(lake.spark):
        return _run(lake, rolling.stream_rolling_features(daily, _SPECS), "rolling")
