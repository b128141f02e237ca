"""Registered queries: splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import latlon_to_km
from ..operators import splits
from .registry import query


def _bucket(key: str, k: int) -> str:
    return f"(('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT % {k})::INTEGER"


_NET = "SELECT d.sensor_id, d.date, d.pm25, s.province, s.lat, s.lon, s.provider FROM station_daily d JOIN stations s USING (sensor_id)"


def _net(lake):
    return lake.station_daily().drop("n").join(lake.stations(), "sensor_id")


@query(
    "year_split",
    """SELECT CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) = 1999 THEN 'dev' ELSE 'test' END AS split, count(*) AS n, avg(pm25) AS mean
    FROM yearly WHERE year(date) BETWEEN 1995 AND 2001 GROUP BY 1""",
    doubles="mean",
)
def _(lake):
    out = splits.year_split(lake.yearly(), [1995, 1996, 1997, 1998], [1999], [2000, 2001])
    return out.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "rolling_year_folds",
    """SELECT f.fold, CASE WHEN year(y.date) = f.fold THEN 'val' ELSE 'train' END AS role, count(*) AS n, avg(pm25) AS mean
    FROM yearly y JOIN (VALUES (1998), (1999), (2000)) f(fold) ON year(y.date) <= f.fold GROUP BY 1, 2""",
    doubles="mean",
)
def _(lake):
    out = splits.rolling_year_folds(lake.yearly(), [1998, 1999, 2000])
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "waterline_split",
    """SELECT sensor_id, date, CASE WHEN date < DATE '2000-01-01' - 180 THEN 'train' ELSE 'val' END AS split FROM yearly WHERE date <= DATE '2000-01-01' - 90""",
)
def _(lake):
    return splits.waterline_split(lake.yearly(), "2000-01-01").select("sensor_id", "date", "split")


@query(
    "monthly_waterlines",
    """SELECT m::DATE AS reference_date, sum((date < m::DATE - 180)::INTEGER)::BIGINT AS n_train, sum((date BETWEEN m::DATE - 180 AND m::DATE - 90)::INTEGER)::BIGINT AS n_val,
      count(DISTINCT CASE WHEN date < m::DATE - 180 THEN year(date) END) AS train_years FROM yearly,
      (SELECT UNNEST(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH)) AS m) GROUP BY 1""",
)
def _(lake):
    return splits.monthly_waterlines(lake.yearly(), "1999-01-01", "2000-12-01")


@query("station_kfold", f"SELECT sensor_id, date, {_bucket('sensor_id', 5)} AS fold FROM station_daily")
def _(lake):
    return splits.station_kfold(lake.station_daily(), 5).select("sensor_id", "date", "fold")


@query(
    "sensor_kfold_in_province",
    f"SELECT sensor_id, date, CASE WHEN province = 'ASIA' THEN {_bucket('sensor_id', 3)} END AS fold FROM ({_NET})",
)
def _(lake):
    return splits.sensor_kfold_in_province(_net(lake), "ASIA", 3).select("sensor_id", "date", "fold")


@query(
    "time_block",
    f"""WITH r AS ({_NET}), c AS (SELECT max(date) - 7 AS d FROM r WHERE province = 'ASIA')
      SELECT sensor_id, date, CASE WHEN date <= d THEN 'train' ELSE 'test' END AS split FROM r, c WHERE date <= d OR province = 'ASIA'""",
)
def _(lake):
    return splits.time_block(_net(lake), "ASIA", 7).select("sensor_id", "date", "split")


_SIZES = []
_g = 300.0
while _g >= 5.0:
    _SIZES.append(_g)
    _g *= 0.7
_BLOCKS = f"""WITH r AS (SELECT province, avg(lat) AS ref FROM stations GROUP BY 1),
  x AS (SELECT s.sensor_id, s.province, g.g AS grid_km, floor(lon*111.32*cos(radians(ref))/g.g)::BIGINT || '_' || floor(lat*110.57/g.g)::BIGINT AS block_id
    FROM stations s JOIN r USING (province), (SELECT UNNEST([{", ".join(repr(s) + "::DOUBLE" for s in _SIZES)}]) AS g) g),
  c AS (SELECT province, max(grid_km) AS grid_km FROM (SELECT province, grid_km, count(DISTINCT block_id) AS n FROM x GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1)
  SELECT sensor_id, province, grid_km, block_id, count(*) OVER () AS _all FROM x JOIN c USING (province, grid_km)"""


@query(
    "grid_blocks",
    f"SELECT sensor_id, province, grid_km, block_id FROM ({_BLOCKS})",
    doubles="grid_km",
)
def _(lake):
    return splits.grid_blocks(lake.stations(), grid_km=300.0).select("sensor_id", "province", "grid_km", "block_id")


_DEFAULT_SIZES = []
_g = 75.0
while _g >= 5.0:
    _DEFAULT_SIZES.append(_g)
    _g *= 0.7
_DEFAULT_BLOCKS = _BLOCKS.replace(", ".join(repr(s) + "::DOUBLE" for s in _SIZES), ", ".join(repr(s) + "::DOUBLE" for s in _DEFAULT_SIZES))


@query(
    "spatial_block_folds",
    f"""WITH b AS (SELECT DISTINCT province, block_id FROM ({_DEFAULT_BLOCKS})), f AS (SELECT province, block_id,
        ((row_number() OVER (PARTITION BY province ORDER BY md5('42:' || province || ':' || block_id)) - 1) % least(5, count(*) OVER (PARTITION BY province)))::INTEGER AS fold FROM b)
      SELECT sensor_id, province, block_id, fold FROM ({_DEFAULT_BLOCKS}) JOIN f USING (province, block_id)""",
)
def _(lake):
    return splits.spatial_block_folds(lake.stations(), 5).select("sensor_id", "province", "block_id", "fold")


_DEG = f"SELECT *, province || '_' || floor(lat/0.5)::BIGINT || '_' || floor(lon/0.5)::BIGINT AS spatial_block FROM ({_NET})"


@query("degree_blocks", f"SELECT spatial_block, count(*) AS n FROM ({_DEG}) GROUP BY 1")
def _(lake):
    return splits.degree_blocks(_net(lake)).groupBy("spatial_block").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_block_split",
    f"""WITH b AS (SELECT province, spatial_block, count(*) AS n FROM ({_DEG}) GROUP BY 1, 2),
      o AS (SELECT *, sum(n) OVER (PARTITION BY province ORDER BY md5('42:' || province || ':' || spatial_block), spatial_block) - n AS before,
        ceil(sum(n) OVER (PARTITION BY province)*0.2) AS target FROM b),
      f AS (SELECT *, before < target AS first FROM o),
      t AS (SELECT *, sum(n) OVER () AS total, sum(CASE WHEN first THEN n ELSE 0 END) OVER () AS val FROM f),
      x AS (SELECT *, val + sum(CASE WHEN first THEN 0 ELSE n END) OVER (ORDER BY first, n DESC, province, spatial_block ROWS UNBOUNDED PRECEDING) - CASE WHEN first THEN 0 ELSE n END AS reached FROM t)
      SELECT province, spatial_block, n, (first OR (reached < greatest(ceil(total*0.25), 500) AND reached < floor(total*0.35)))::INTEGER AS is_val FROM x""",
)
def _(lake):
    return splits.stratified_block_split(splits.degree_blocks(_net(lake)), min_val_frac=0.25, min_val_rows=500)


@query(
    "leave_one_province_out",
    f"""SELECT province, count(*) AS n_test, count(DISTINCT sensor_id) AS n_stations, (SELECT count(*) FROM ({_NET})) - count(*) AS n_train FROM ({_NET}) GROUP BY 1
      HAVING count(DISTINCT sensor_id) >= 2 AND count(*) >= 30""",
)
def _(lake):
    return splits.leave_one_province_out(_net(lake))


@query(
    "nested_month_station_folds",
    f"""WITH p AS (SELECT strftime(date, '%Y-%m') AS month, sensor_id, count(*) AS n, {_bucket('sensor_id', 3)} AS own FROM yearly GROUP BY 1, 2),
      m AS (SELECT DISTINCT month AS test_month FROM p WHERE month > (SELECT min(month) FROM p)),
      x AS (SELECT m.test_month, f.fold, p.sensor_id, p.n, CASE WHEN own = f.fold AND p.month = m.test_month THEN 'test' WHEN own <> f.fold AND p.month = m.test_month THEN 'anchor' WHEN own <> f.fold THEN 'train' END AS role
        FROM p JOIN m ON m.test_month >= p.month, (VALUES (0),(1),(2)) f(fold))
      SELECT test_month, fold, role, sum(n)::BIGINT AS n, count(DISTINCT sensor_id) AS n_stations FROM x WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(lake):
    return splits.nested_month_station_folds(lake.yearly(), 3)


@query(
    "random_holdout",
    f"""SELECT event_id, {_bucket('event_id', 100)} < 20 AS is_val, {_bucket('user_id', 100)} < 20 AS station_is_val FROM events""",
)
def _(lake):
    rows = splits.random_holdout(lake.readings(), F.col("event_id"))
    stations = splits.random_holdout(rows.withColumnRenamed("is_val", "_rows"), F.col("sensor_id"))
    return stations.select("event_id", F.col("_rows").alias("is_val"), F.col("is_val").alias("station_is_val"))


@query(
    "history_dropout",
    f"""SELECT sensor_id, date, d::INTEGER AS history_dropped, CASE WHEN NOT d THEN lag1 END AS pm25_lag1, CASE WHEN NOT d THEN lag2 END AS pm25_lag2 FROM (
      SELECT sensor_id, date, {_bucket("(sensor_id || '@' || date)", 100)} < 20 AS d, lag(pm25, 1) OVER w AS lag1, lag(pm25, 2) OVER w AS lag2 FROM station_daily WINDOW w AS (PARTITION BY sensor_id ORDER BY date))""",
    doubles="pm25_lag1 pm25_lag2",
)
def _(lake):
    from ..operators.temporal import target_lags

    lags = target_lags(lake.station_daily().drop("n"), lags=(1, 2))
    key = F.concat_ws("@", F.col("sensor_id").cast("string"), F.col("date").cast("string"))
    return splits.history_dropout(lags, ["pm25_lag1", "pm25_lag2"], key).drop("pm25")


# k-means has no closed form; what makes its answer right is that it stays: every site is nearest to its own block's mean
@query("kmeans_blocks", "SELECT sensor_id, 12::BIGINT AS n_blocks, true AS nearest_is_own FROM stations")
def _(lake):
    sites = lake.stations()
    x, y = latlon_to_km(F.col("lat"), F.col("lon"), sites.agg(F.avg("lat")).scalar())
    placed = splits.kmeans_blocks(lake.stations(), n_blocks=12).join(sites.select("sensor_id", x.alias("x"), y.alias("y")), "sensor_id")
    means = placed.groupBy("block_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    all_means = means.agg(F.collect_list(F.struct("block_id", "x", "y"))).scalar()  # twelve
    gap = lambda m: F.sqrt(F.pow(m["x"] - F.col("x"), 2) + F.pow(m["y"] - F.col("y"), 2))
    checked = placed.withColumn("_m", all_means)
    least = F.array_min(F.transform("_m", gap))
    own = gap(F.filter("_m", lambda m: m["block_id"] == F.col("block_id"))[0])
    return checked.select("sensor_id", F.size("_m").cast("long").alias("n_blocks"), (own <= least + 1e-6).alias("nearest_is_own"))
