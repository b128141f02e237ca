"""Registered queries: top-k reports, set operations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, naming
from ..operators import assemble, evaluate, grids, stations
from .aggregates import _ACTIVITY, _BY_STATION, _activity
from .joins import CUBE_LAT, CUBE_LON, _FILE_KEYS, _window, per_point, window_pixels
from .registry import query


@query(
    "top_stations",
    f"SELECT sensor_id, valid_days, mean_pm25 FROM ({_ACTIVITY}) ORDER BY valid_days DESC, sensor_id LIMIT 10",
    doubles="mean_pm25",
)
def _(lake):
    top = _activity(lake).orderBy(F.desc("valid_days"), "sensor_id").limit(10)
    return top.select("sensor_id", "valid_days", "mean_pm25")


@query(
    "top_cities",
    f"SELECT round(lat)::BIGINT || '_' || round(lon)::BIGINT AS city, count(*) AS n_active FROM ({_ACTIVITY}) WHERE active = 1 GROUP BY 1 ORDER BY n_active DESC, city LIMIT 15",
)
def _(lake):
    city = F.concat_ws("_", F.round("lat").cast("long").cast("string"), F.round("lon").cast("long").cast("string"))
    counts = stations.active_by_region(_activity(lake).withColumn("city", city), "city")
    return counts.orderBy(F.desc("n_active"), "city").limit(15)


@query(
    "worst_stations",
    f"SELECT sensor_id, mae, n_predictions FROM ({_BY_STATION}) ORDER BY mae DESC, sensor_id LIMIT 10",
    doubles="mae",
)
def _(lake):
    worst = evaluate.metrics_by_station(lake.predictions()).orderBy(F.desc("mae"), "sensor_id").limit(10)
    return worst.select("sensor_id", "mae", "n_predictions")


_PART_NAME = "CASE p_partkey % 3 WHEN 0 THEN 'no2_' WHEN 1 THEN 'nh3_' ELSE 'WS10_' END || p_partkey || '_daily_mean'"


def _importance(lake):
    k = F.col("p_partkey")
    prefix = F.when(k % 3 == 0, "no2_").when(k % 3 == 1, "nh3_").otherwise("WS10_")
    return lake.table("part").select(
        F.concat(prefix, k.cast("string"), F.lit("_daily_mean")).alias("feature"), F.col("p_retailprice").alias("importance")
    )


@query(
    "top_features",
    f"""SELECT {_PART_NAME} AS feature, p_retailprice AS importance, 'met' AS stage, 'MET' AS family FROM part ORDER BY p_retailprice DESC, feature LIMIT 30""",
    doubles="importance",
)
def _(lake):
    # the daily-mean suffix is a weather pattern and is checked before the gas prefixes
    top = _importance(lake).orderBy(F.desc("importance"), "feature").limit(30)
    staged = naming.classify_features(top, name="feature")
    return staged.withColumn("family", naming.feature_family(F.col("feature"), F.col("stage")))


@query(
    "importance_share",
    """SELECT p_brand AS family, sum(p_retailprice)/(SELECT sum(p_retailprice) FROM part) AS share, max(p_retailprice)/(SELECT sum(p_retailprice) FROM part) AS top_share
    FROM part GROUP BY 1""",
    doubles="share top_share",
    digits=9,
)
def _(lake):
    part = lake.table("part")
    total = part.agg(F.sum("p_retailprice")).scalar()
    share = F.try_divide("p_retailprice", total)
    return part.withColumn("_s", share).groupBy(F.col("p_brand").alias("family")).agg(
        F.sum("_s").alias("share"), F.max("_s").alias("top_share")
    )


_NULL_COLS = "WS10 blh RH".split()


@query(
    "top_null_features",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(({c} IS NULL)::INTEGER) AS null_share FROM met_readings" for c in _NULL_COLS),
    doubles="null_share",
)
def _(lake):
    return assemble.top_null_features(lake.met_readings(), ["event_id", "sensor_id", *_NULL_COLS])


@query(
    "recent_registry",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_added FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
)
def _(lake):
    latest = lake.table("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return latest.select("o_orderkey", F.to_date("o_orderdate").alias("date_added"))


@query(
    "rank_models",
    """SELECT model, mae, row_number() OVER (ORDER BY mae NULLS LAST, model)::INTEGER AS rank FROM (SELECT 'm' || (event_id % 6) AS model,
      avg(CASE WHEN event_id % 6 < 5 THEN abs(y_pred - y_true) END) AS mae FROM predictions GROUP BY 1)""",
    doubles="mae",
)
def _(lake):
    model = F.concat(F.lit("m"), (F.col("event_id") % 6).cast("string"))
    error = F.when(F.col("event_id") % 6 < 5, F.abs(F.col("y_pred") - F.col("y_true")))
    table = lake.predictions().groupBy(model.alias("model")).agg(F.avg(error).alias("mae"))
    # one row per model
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("mae"), "model")))


@query("sort_by_station_time", "SELECT sensor_id, date, pm25 FROM station_daily", doubles="pm25")
def _(lake):
    return lake.station_daily().drop("n").orderBy("sensor_id", "date")


@query(
    "union_partitions",
    """SELECT sensor_id, date, pm25, NULL::DOUBLE AS WS10 FROM station_daily UNION ALL SELECT sensor_id, date, NULL, WS10 FROM met_daily""",
    doubles="pm25 WS10",
)
def _(lake):
    return assemble.union_partitions([lake.station_daily().drop("n"), lake.met_daily().select("sensor_id", "date", "WS10")])


@query(
    "union_sources",
    """SELECT source, count(*) AS n, avg(pm25) AS mean FROM (SELECT 'events' AS source, pm25 FROM station_daily UNION ALL SELECT 'orders', pm25 FROM yearly) GROUP BY 1""",
    doubles="mean",
)
def _(lake):
    low = lake.station_daily().drop("n").withColumn("source", F.lit("events"))
    regulatory = lake.yearly().withColumn("source", F.lit("orders"))
    return low.unionByName(regulatory).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "dedup_first",
    """SELECT sensor_id, date, event_id, pm25 FROM (SELECT user_id AS sensor_id, CAST(ts AS DATE) AS date, event_id, value AS pm25,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
    doubles="pm25",
)
def _(lake):
    rows = lake.readings().select("sensor_id", F.to_date("ts").alias("date"), "event_id", "pm25")
    return assemble.dedup_first(rows, ["sensor_id", "date"], ["event_id"])


@query(
    "distinct_sites",
    """SELECT round(lat, 3)::VARCHAR || '_' || round(lon, 3)::VARCHAR AS site_key, min(lat) AS lat, min(lon) AS lon FROM station_daily JOIN stations USING (sensor_id) GROUP BY 1""",
    doubles="lat lon",
)
def _(lake):
    rows = lake.station_daily().join(lake.stations(), "sensor_id")
    keyed = rows.withColumn("site_key", ids.site_key(F.col("lat"), F.col("lon")))
    return assemble.distinct_sites(keyed, "site_key")


@query(
    "registry_upsert",
    """SELECT p_name || '_' || p_partkey AS column_name, CASE WHEN p_size > 25 THEN 'gas' ELSE p_type END AS stage, (p_size > 25 OR p_size > 10)::INTEGER AS used_in_training FROM part""",
)
def _(lake):
    part = lake.table("part")
    name = F.concat_ws("_", F.col("p_name"), F.col("p_partkey").cast("string")).alias("column_name")
    old = part.select(name, F.col("p_type").alias("stage"), (F.col("p_size") > 10).alias("used_in_training"))
    new = part.where("p_size > 25").select(name, F.lit("gas").alias("stage"), F.lit(True).alias("used_in_training"))
    return assemble.registry_upsert(old, new)


@query("export_stage_metadata", "SELECT DISTINCT sensor_id, date, product, invalid_reason FROM (SELECT sensor_id, date, product, CASE WHEN value IS NULL THEN 'fill' WHEN qa < 0.75 THEN 'low_quality' ELSE '' END AS invalid_reason FROM (" + _window(1) + "))")
def _(lake):
    reason = F.when(F.col("value").isNull(), "fill").when(F.col("qa") < 0.75, "low_quality").otherwise("")

    def compute(addresses):
        return window_pixels(addresses, lake, 1).select(*_FILE_KEYS, reason.alias("invalid_reason")).distinct()

    return per_point(lake, compute)


@query(
    "validate_stage_output",
    """SELECT 'missing_feature' AS issue, 'no2_median' AS column_name, count(*) AS n_rows FROM met_daily UNION ALL
      SELECT 'non_numeric', 'station', count(*) FROM met_daily UNION ALL SELECT 'target_leakage', 'pm25_lag1', count(*) FROM met_daily UNION ALL
      SELECT 'missing_feature', 'pm25_lag1', count(*) FROM met_daily UNION ALL SELECT 'missing_key', 'time', count(*) FROM met_daily""",
)
def _(lake):
    stage = lake.met_daily().withColumn("station", F.col("sensor_id").cast("string"))
    return assemble.validate_stage_output(stage, ["WS10", "no2_median", "station", "pm25_lag1"], ["sensor_id", "time"])


@query(
    "export_grid_rows",
    """SELECT c.date, c.iy AS prow, array_to_string(list_transform(list(coalesce(m.value, -9999.0::DOUBLE) ORDER BY g.ix), lambda x: round(x + 3.7e-7, 4)::DECIMAL(18,4)), ';') AS vals
      FROM (SELECT DISTINCT date, iy FROM met_cube) c CROSS JOIN (SELECT i AS ix FROM range(13) t(i)) g LEFT JOIN met_cube m ON m.date = c.date AND m.iy = c.iy AND m.ix = g.ix GROUP BY 1, 2""",
)
def _(lake):
    grid = lake.met_cube().withColumnsRenamed({"iy": "prow", "ix": "pcol"})
    rows = grids.export_grid_rows(grid, 13)
    text = F.transform("values", lambda v: F.round(v + 3.7e-7, 4).cast("decimal(18,4)").cast("string"))
    return rows.select("date", "prow", F.array_join(text, ";").alias("vals"))


@query(
    "export_predictions_json",
    """SELECT date, count(*) AS n_cells, avg(value) AS mean, median(value) AS median, max(37.3 - 1.4*iy) AS north, sum(round(value + 3.7e-5, 2)) AS total FROM met_cube GROUP BY 1""",
    doubles="mean median north total",
    digits=4,
)
def _(lake):
    grid = lake.met_cube().select(
        "date",
        F.col("iy").alias("row"),
        F.col("ix").alias("col"),
        CUBE_LAT.value(F.col("iy")).alias("lat"),
        CUBE_LON.value(F.col("ix")).alias("lon"),
        (F.col("value") + 3.7e-5).alias("pm25"),
    )
    docs = grids.export_predictions_json(grid)
    # read the documents back, as a web client would
    d = F.from_json("document", "grid struct<bounds:struct<north:double>>, stats struct<mean:double,median:double,n_valid:bigint>, pm25 array<double>")
    return docs.withColumn("d", d).select(
        "date",
        F.col("d.stats.n_valid").alias("n_cells"),
        (F.col("d.stats.mean") - 3.7e-5).alias("mean"),
        (F.col("d.stats.median") - 3.7e-5).alias("median"),
        F.col("d.grid.bounds.north").alias("north"),
        F.aggregate("d.pm25", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "export_validation_table",
    """SELECT strftime(p.date, '%Y-%m-%d') AS date, 'PK' || substr(sha1('salt:' || p.sensor_id), 1, 10) AS station_id, p.event_id, s.province,
      round_even(p.y_true, 1) AS pm25_observed, round(p.y_pred + 3.7e-5, 2) AS pred_with_history FROM predictions p JOIN stations s USING (sensor_id)""",
)
def _(lake):
    p = lake.predictions().join(lake.stations().select("sensor_id", "province"), "sensor_id")
    table = p.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        ids.anonymous_station_key(F.col("sensor_id"), "salt:").alias("station_id"),
        "event_id",
        "province",
        F.bround("y_true", 1).alias("pm25_observed"),
        F.round(F.col("y_pred") + 3.7e-5, 2).alias("pred_with_history"),
    )
    return table.orderBy("date", "station_id", "event_id")


