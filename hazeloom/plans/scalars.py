"""Registered queries: ids, calendar, weather scalars, masks, geometry, names and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aqi, geo, ids, met, naming, quality, timecols
from ..operators import grids
from ..semantics import coerce_numeric, finite
from .registry import query


@query(
    "normalize_time_utc",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
    UNION ALL SELECT o_orderkey + 1000000000, CAST(NULL AS DATE) FROM orders""",
)
def _(lake):
    o = lake.table("orders")
    good = o.select("o_orderkey", F.concat(F.col("o_orderdate").cast("string"), F.lit("Z")).alias("t"))
    bad = o.select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), F.concat(F.lit("day "), F.col("o_orderkey").cast("string")).alias("t"))
    return good.unionByName(bad).select("o_orderkey", timecols.normalize_time_utc(F.col("t")).alias("day"))


@query(
    "coerce_numeric",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number
    FROM events""",
    doubles="number",
)
def _(lake):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return lake.table("events").select("event_id", coerce_numeric(text).alias("number"))


@query(
    "nonfinite_to_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity / l_tax END AS ratio FROM lineitem""",
    doubles="ratio",
)
def _(lake):
    # a division by zero yields infinity before the clean-up
    ratio = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.col("l_tax"))
    return lake.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", finite(ratio).alias("ratio"))


@query(
    "sensor_id",
    "SELECT sensor_id AS station, ('0x' || substr(sha1(printf('%.5f,%.5f', lat, lon)), 1, 8))::BIGINT AS sensor_id FROM stations",
)
def _(lake):
    return lake.stations().select(
        F.col("sensor_id").alias("station"), ids.sensor_id(F.col("lat"), F.col("lon")).alias("sensor_id")
    )


@query(
    "sensor_slug",
    r"""SELECT c_custkey, coalesce(nullif(trim(regexp_replace(regexp_replace(
        lower(c_name || '_' || c_mktsegment), '[^\w]+', '_', 'g'), '__+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM customer""",
)
def _(lake):
    return lake.table("customer").select("c_custkey", ids.sensor_slug(F.col("c_name"), F.col("c_mktsegment")).alias("slug"))


@query("cell_id", "SELECT sensor_id, printf('%.2f_%.2f', lat, lon) AS cell_id FROM stations")
def _(lake):
    return lake.stations().select("sensor_id", ids.cell_id(F.col("lat"), F.col("lon")).alias("cell_id"))


@query(
    "site_key",
    "SELECT sensor_id, CAST(round(lat, 3) AS VARCHAR) || '_' || CAST(round(lon, 3) AS VARCHAR) AS site_key FROM stations",
)
def _(lake):
    return lake.stations().select("sensor_id", ids.site_key(F.col("lat"), F.col("lon")).alias("site_key"))


@query("target_filter", "SELECT event_id, value AS pm25 FROM events WHERE value IS NOT NULL AND value >= 5.0", doubles="pm25")
def _(lake):
    from ..constants import TARGET_FLOOR_UGM3

    return lake.readings().where(F.col("pm25") >= TARGET_FLOOR_UGM3).select("event_id", "pm25")


@query(
    "date_range_filter",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-08-31'""",
)
def _(lake):
    o = lake.table("orders")
    # plain comparisons on the stored column reach the Parquet reader
    d = F.col("o_orderdate")
    keep = d.between(F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1998-08-31").cast("timestamp_ntz"))
    return o.where(keep).select("o_orderkey", F.to_date(d).alias("date"))


@query("year_filter", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) IN (1996, 1999)")
def _(lake):
    year = F.year("o_orderdate")
    return lake.table("orders").where(year.isin(1996, 1999)).select("o_orderkey", year.alias("year"))


@query(
    "bbox_filter",
    "SELECT sensor_id, lat, lon FROM stations WHERE lat BETWEEN 24.0 AND 33.0 AND lon BETWEEN 62.0 AND 74.0",
    doubles="lat lon",
)
def _(lake):
    return lake.stations().where(geo.in_bbox(F.col("lat"), F.col("lon"), 24.0, 33.0, 62.0, 74.0)).select("sensor_id", "lat", "lon")


@query(
    "first_available_band",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS value, l_discount AS qa,
    'l_extendedprice' AS band_used, 1 AS qa_available FROM lineitem""",
    doubles="value qa",
)
def _(lake):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = quality.first_available_band(
        lake.table("lineitem"), ["tropospheric_column", "l_extendedprice", "l_quantity"], ["qa_value", "l_discount"], "l_quantity"
    )
    return out.select(*keys, "value", "qa", "band_used", "qa_available")


@query(
    "physical_range_mask",
    """SELECT event_id, CASE WHEN value/20 - 0.1 BETWEEN -0.05 AND 5.0 THEN value/20 - 0.1 END AS aod,
      CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS raster,
      CASE WHEN event_id % 13 = 0 THEN 'missing_coordinates' WHEN user_id*53 % 400 > 180 THEN 'coordinates_out_of_range' ELSE '' END
        AS invalid_reason FROM events""",
    doubles="aod raster",
)
def _(lake):
    e = lake.table("events").select(
        "event_id",
        (F.col("value") / 20 - 0.1).alias("aod"),
        F.when(F.col("event_id") % 9 == 0, 1e15).otherwise(F.col("value")).alias("raster"),
        F.when(F.col("event_id") % 13 != 0, F.lit(30.0)).alias("lat"),
        (F.col("user_id") * 53 % 400).cast("double").alias("lon"),
    )
    return quality.physical_range_mask(e, "aod", "raster", "lat", "lon").drop("lat", "lon")


@query(
    "scale_offset_fill",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity = 1 THEN NULL ELSE
      l_quantity * CASE l_returnflag WHEN 'A' THEN 0.001 WHEN 'N' THEN 0.01 ELSE 0.1 END
      + CASE l_returnflag WHEN 'A' THEN 0.5 ELSE 0.0 END END AS value FROM lineitem""",
    doubles="value",
)
def _(lake):
    line = lake.table("lineitem")
    product = F.col("l_returnflag")
    scale = F.when(product == "A", 0.001).when(product == "N", 0.01).otherwise(0.1)
    offset = F.when(product == "A", 0.5).otherwise(0.0)
    value = quality.scale_offset_fill(F.col("l_quantity"), scale, offset, F.lit(1.0))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"))


@query(
    "qa_filter",
    """SELECT date, product, count(CASE WHEN qa >= 0.75 THEN value END) AS n_valid,
    avg(CASE WHEN qa >= 0.75 THEN value END) AS mean, avg(CASE WHEN qa >= 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_fraction
    FROM gas_pixels GROUP BY 1, 2""",
    doubles="mean pass_fraction",
)
def _(lake):
    kept = quality.qa_filter(F.col("value"), F.col("qa"))
    return lake.gas_pixels().groupBy("date", "product").agg(
        F.count(kept).alias("n_valid"),
        F.avg(kept).alias("mean"),
        F.avg(quality.qa_pass(F.col("qa")).cast("double")).alias("pass_fraction"),
    )


@query(
    "qa_bitfield_decode",
    """SELECT event_id, ((event_id % 4096) & 7)::INTEGER AS qa_cloudmask, (((event_id % 4096) >> 5) & 7)::INTEGER AS qa_adjacency,
    (((event_id % 4096) >> 8) & 15)::INTEGER AS qa_aod FROM events""",
)
def _(lake):
    return lake.table("events").select("event_id").withColumns(quality.qa_bits(F.col("event_id") % 4096))


@query(
    "modis_tile_pixel",
    """SELECT sensor_id, h, v, trunc((dn - v*1111950.5197665554::DOUBLE) / (1111950.5197665554::DOUBLE/1200))::INTEGER AS prow,
      trunc((de - h*1111950.5197665554::DOUBLE) / (1111950.5197665554::DOUBLE/1200))::INTEGER AS pcol
    FROM (SELECT *, trunc(de/1111950.5197665554::DOUBLE)::INTEGER AS h, trunc(dn/1111950.5197665554::DOUBLE)::INTEGER AS v FROM (
      SELECT sensor_id, 6371007.181::DOUBLE*radians(lon)*cos(radians(lat)) + 20015109.353729::DOUBLE AS de,
        10007554.676865::DOUBLE - 6371007.181::DOUBLE*radians(lat) AS dn FROM stations))""",
)
def _(lake):
    tile = geo.sinusoidal_tile_pixel(F.col("lat"), F.col("lon"))
    return lake.stations().select("sensor_id", tile.alias("t")).select(
        "sensor_id", "t.h", "t.v", F.col("t.row").alias("prow"), F.col("t.col").alias("pcol")
    )


@query(
    "latlon_to_km",
    """SELECT sensor_id, lon*111.32*cos(radians((SELECT avg(lat) FROM stations))) AS x_km, lat*110.57 AS y_km FROM stations""",
    doubles="x_km y_km",
)
def _(lake):
    s = lake.stations()
    x, y = geo.latlon_to_km(F.col("lat"), F.col("lon"), s.agg(F.avg("lat")).scalar())
    return s.select("sensor_id", x.alias("x_km"), y.alias("y_km"))


@query(
    "pixels_per_km",
    """SELECT sensor_id, (1/(0.01::DOUBLE*111.32*cos(radians(lat))) + 1/(0.01::DOUBLE*110.54))/2 AS px_per_km FROM stations""",
    doubles="px_per_km",
)
def _(lake):
    per = geo.pixels_per_km(F.col("lat"), F.lit(0.01), F.lit(0.01))
    return lake.stations().select("sensor_id", per.alias("px_per_km"))


@query(
    "haversine_km",
    """SELECT sensor_id, 2*6371.0*asin(sqrt(pow(sin(radians(31.5204-lat)/2),2)
      + cos(radians(lat))*cos(radians(31.5204))*pow(sin(radians(74.3587-lon)/2),2))) AS km FROM stations""",
    doubles="km",
)
def _(lake):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(31.5204), F.lit(74.3587))
    return lake.stations().select("sensor_id", km.alias("km"))


@query(
    "normalize_longitude",
    """SELECT sensor_id, ((lon - 120) + 360) - 360*floor(((lon - 120) + 360)/360) AS lon360 FROM stations""",
    doubles="lon360",
)
def _(lake):
    west = lake.stations().select("sensor_id", (F.col("lon") - 120).alias("lon"))
    low = west.agg(F.min("lon")).scalar()
    return west.select("sensor_id", geo.normalize_longitude(F.col("lon"), F.lit(359.75), low).alias("lon360"))


@query(
    "calendar_encodings",
    """SELECT sensor_id, date, dayofyear(date)::INTEGER AS day_of_year, month(date)::INTEGER AS month, year(date)::INTEGER AS year,
      sin(2*pi()*dayofyear(date)/366.0) AS doy_sin, cos(2*pi()*dayofyear(date)/366.0) AS doy_cos,
      sin(4*pi()*dayofyear(date)/366.0) AS doy_sin_2, cos(4*pi()*dayofyear(date)/366.0) AS doy_cos_2,
      sin(6*pi()*dayofyear(date)/366.0) AS doy_sin_3, cos(6*pi()*dayofyear(date)/366.0) AS doy_cos_3,
      (month(date) IN (11,12,1,2))::INTEGER AS heating_season_flag, (month(date) IN (10,11))::INTEGER AS burning_season_flag
    FROM yearly""",
    doubles="doy_sin doy_cos doy_sin_2 doy_cos_2 doy_sin_3 doy_cos_3",
)
def _(lake):
    return timecols.calendar_encodings(lake.yearly().select("sensor_id", "date"))


@query(
    "season_label",
    """SELECT CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'pre_monsoon'
      WHEN month(date) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season, count(*) AS n, avg(pm25) AS mean
    FROM yearly GROUP BY 1""",
    doubles="mean",
)
def _(lake):
    season = timecols.season_label(F.month("date")).alias("season")
    return lake.yearly().groupBy(season).agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "thermo_features",
    """SELECT event_id, CASE WHEN rh > 100 THEN 100 WHEN rh < 0 THEN 0 ELSE rh END AS RH, 0.622*e/(sp/100 - 0.378*e) AS q,
      CASE WHEN es - e < 0 THEN 0 ELSE es - e END AS VPD, (t2m - 273.15) - (d2m - 273.15) AS dT, t2m*pow(1e5/sp, 287.0::DOUBLE/1004.0) AS theta
    FROM (SELECT *, 100.0*e/es AS rh FROM (SELECT event_id, t2m, d2m, sp,
      6.112*exp(17.67*(t2m-273.15::DOUBLE)/((t2m-273.15::DOUBLE)+243.5)) AS es,
      6.112*exp(17.67*(d2m-273.15::DOUBLE)/((d2m-273.15::DOUBLE)+243.5)) AS e FROM met_readings))""",
    doubles="RH q VPD dT theta",
)
def _(lake):
    cols = met.thermo_features(F.col("t2m"), F.col("d2m"), F.col("sp"))
    return lake.met_readings().select("event_id", *[c.alias(n) for n, c in cols.items()])


_UV = """SELECT event_id, user_id, ts, value, (value/10 + 0.05::DOUBLE)*sin(radians(event_id % 360)) AS u10, (value/10 + 0.05::DOUBLE)*cos(radians(event_id % 360)) AS v10,
  (value/8 + 0.05::DOUBLE)*sin(radians(event_id*7 % 360)) AS u100, (value/8 + 0.05::DOUBLE)*cos(radians(event_id*7 % 360)) AS v100, event_id % 101 AS cover FROM events"""


def _uv(lake):
    e = F.col("event_id")
    return lake.table("events").select(
        "event_id",
        F.col("user_id").alias("sensor_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("value") / 10 + 0.05) * F.sin(F.radians(e % 360))).alias("u10"),
        ((F.col("value") / 10 + 0.05) * F.cos(F.radians(e % 360))).alias("v10"),
        ((F.col("value") / 8 + 0.05) * F.sin(F.radians(e * 7 % 360))).alias("u100"),
        ((F.col("value") / 8 + 0.05) * F.cos(F.radians(e * 7 % 360))).alias("v100"),
        (e % 101).cast("double").alias("tcc"),
    )


@query(
    "wind_features",
    f"""SELECT event_id, ws10 AS WS10, round(wd10, 6) % 360 AS WD10, ws100 AS WS100, round(wd100, 6) % 360 AS WD100, ws100 - ws10 AS dWS,
      CASE WHEN round(d - 360*floor(d/360), 6) = 0 THEN 180 ELSE d - 360*floor(d/360) - 180 END AS dWD
    FROM (SELECT *, wd100 - wd10 + 180 AS d FROM (SELECT event_id, sqrt(u10*u10+v10*v10) AS ws10, sqrt(u100*u100+v100*v100) AS ws100,
      degrees(atan2(-u10,-v10)) + CASE WHEN atan2(-u10,-v10) < 0 THEN 360 ELSE 0 END AS wd10,
      degrees(atan2(-u100,-v100)) + CASE WHEN atan2(-u100,-v100) < 0 THEN 360 ELSE 0 END AS wd100 FROM ({_UV})))""",
    doubles="WS10 WD10 WS100 WD100 dWS dWD",
)
def _(lake):
    cols = met.wind_features(F.col("u10"), F.col("v10"), F.col("u100"), F.col("v100"))
    out = _uv(lake).select("event_id", *[c.alias(n) for n, c in cols.items()])
    # a direction just under 360 degrees and 0 are the same reading, and so are half turns either way
    half_turn = F.when(F.round("dWD", 6) == -180, 180.0).otherwise(F.col("dWD"))
    return out.withColumns({c: F.round(c, 6) % 360 for c in ("WD10", "WD100")} | {"dWD": half_turn})


@query(
    "clear_sky",
    "SELECT event_id, 1.0 - (event_id % 101)/100.0::DOUBLE AS CLR FROM events",
    doubles="CLR",
)
def _(lake):
    return met.clear_sky(_uv(lake)).select("event_id", "CLR")


@query(
    "shear_abs",
    "SELECT sensor_id, date, abs(dWS) AS dWS_abs, abs(dWD) AS dWD_abs FROM met_daily",
    doubles="dWS_abs dWD_abs",
)
def _(lake):
    return met.shear_abs(lake.met_daily()).select("sensor_id", "date", "dWS_abs", "dWD_abs")


@query(
    "core_met_backfill",
    """SELECT sensor_id, date, WS10, 1.0 - RH/101 AS CLR, blh - lag(blh) OVER w AS BLH_tend, sp - lag(sp) OVER w AS SP_tend,
      t2m - lag(t2m) OVER w AS dT, coalesce(WS10 < 2 AND blh < 300, false)::INTEGER AS Stagnant, coalesce(RH > 80, false)::INTEGER AS HighRH
    FROM met_daily WINDOW w AS (PARTITION BY sensor_id ORDER BY date)""",
    doubles="WS10 CLR BLH_tend SP_tend dT",
)
def _(lake):
    raw = lake.met_daily().select("sensor_id", "date", "WS10", "blh", "RH", "sp", "t2m", (F.col("RH") / 101).alias("tcc"))
    out = met.core_met_backfill(raw, "sensor_id", "date")
    return out.select("sensor_id", "date", "WS10", "CLR", "BLH_tend", "SP_tend", "dT", "Stagnant", "HighRH")


_NAMES = ["WS10_rollmean_3d", "no2_median", "optical_depth_055", "grid_id", "urban fraction", "pm25", "nh3_p90", "doy_sin"]
_STAGE_OF = ["met", "tropomi", "aod", "meta", "static", "unknown", "tropomi", "met"]
_FAMILY_OF = ["MET", "TROPOMI", "AOD", "MET", "MET", "MET", "NH3", "MET"]


def _sql_pick(values):
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _feature_names(lake):
    pick = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 8).cast("int"))
    return lake.table("part").select("p_partkey", pick.alias("column_name"))


@query("feature_stage", f"SELECT p_partkey, {_sql_pick(_NAMES)} AS column_name, {_sql_pick(_STAGE_OF)} AS stage FROM part")
def _(lake):
    return naming.classify_features(_feature_names(lake))


@query(
    "feature_family",
    f"SELECT {_sql_pick(_FAMILY_OF)} AS family, count(*) AS n FROM part GROUP BY 1",
)
def _(lake):
    staged = naming.classify_features(_feature_names(lake))
    return staged.groupBy(naming.feature_family(F.col("column_name"), F.col("stage")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "missing_flags",
    """SELECT sensor_id, date, (WS10 IS NULL)::INTEGER AS WS10_missing, (t2m IS NULL)::INTEGER AS t2m_missing,
    (WS10 IS NOT NULL OR blh IS NOT NULL)::INTEGER AS wind_available FROM met_daily""",
)
def _(lake):
    out = quality.missing_flags(lake.met_daily(), ["WS10", "t2m", "absent"], {"wind": ["WS10", "blh", "absent"]})
    return out.select("sensor_id", "date", "WS10_missing", "t2m_missing", "wind_available")


@query(
    "clip_and_mask_predictions",
    """SELECT event_id, CASE WHEN iy BETWEEN 2 AND 8 THEN greatest(y_pred - 60, 0) END AS pm25 FROM predictions""",
    doubles="pm25",
)
def _(lake):
    p = lake.predictions()
    return p.select("event_id", quality.clip_and_mask(F.col("y_pred") - 60, F.col("iy").between(2, 8)).alias("pm25"))


_AQI_SQL = "CASE " + " ".join(
    f"WHEN c BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN (c - {lo}::DOUBLE)*(({ih} - {il})/({hi}::DOUBLE - {lo}::DOUBLE)) + {il}"
    for lo, hi, il, ih in aqi.AQI_BANDS
) + " END"


@query(
    "pm25_to_aqi",
    f"SELECT event_id, {_AQI_SQL} AS aqi FROM (SELECT event_id, floor(value*3*10)/10 AS c FROM events)",
    doubles="aqi",
)
def _(lake):
    return lake.readings().select("event_id", aqi.pm25_to_aqi(F.col("pm25") * 3).alias("aqi"))


@query(
    "tail_weights",
    """SELECT event_id, least(1 + (value >= 100)::INTEGER + 3*(value >= 150)::INTEGER + 6*(value >= 200)::INTEGER, 12)::DOUBLE AS weight
    FROM events""",
    doubles="weight",
)
def _(lake):
    return lake.readings().select("event_id", aqi.tail_weights(F.col("pm25")).alias("weight"))


@query(
    "group_weights",
    """SELECT provider, count(*) AS n, sum(CASE provider WHEN 'regulatory' THEN 10.0::DOUBLE ELSE 1.0 END) AS weight
    FROM station_daily JOIN stations USING (sensor_id) GROUP BY 1""",
    doubles="weight",
)
def _(lake):
    rows = lake.station_daily().join(lake.stations(), "sensor_id")
    w = aqi.group_weights(F.col("provider") == "regulatory")
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"))


@query(
    "station_unit_coords",
    """SELECT sensor_id, greatest(-1, least(1, 2*((lon - 60.5::DOUBLE)/0.1::DOUBLE)/174 - 1)) AS x,
      greatest(-1, least(1, 2*((37.3::DOUBLE - lat)/0.1::DOUBLE)/140 - 1)) AS y FROM stations""",
    doubles="x y",
)
def _(lake):
    x, y = geo.station_unit_coords(F.col("lat"), F.col("lon"))
    return lake.stations().select("sensor_id", x.alias("x"), y.alias("y"))


@query(
    "norm_stats",
    """SELECT f AS feature, CASE f WHEN 'calm' THEN 0 ELSE avg(v) END AS mean,
      CASE f WHEN 'calm' THEN 1 ELSE greatest(sqrt(greatest(var_pop(v), 1e-8)), 1e-6) END AS std, count(v) AS n FROM (
      SELECT UNNEST(['WS10','RH','calm']) AS f, UNNEST([WS10, RH, (WS10 < 2)::INTEGER::DOUBLE]) AS v FROM met_daily) GROUP BY f""",
    doubles="mean std",
)
def _(lake):
    daily = lake.met_daily().withColumn("calm", (F.col("WS10") < 2).cast("int"))
    return grids.norm_stats(daily, ["WS10", "RH", "calm"], binary=["calm"])


@query(
    "zscore_and_mask",
    """SELECT sensor_id, date, (WS10 IS NOT NULL)::INTEGER AS WS10_valid, coalesce(greatest(-20, least(20, (WS10 - m)/s)), 0) AS WS10_z
      FROM met_daily, (SELECT avg(WS10) AS m, greatest(sqrt(greatest(var_pop(WS10), 1e-8)), 1e-6) AS s FROM met_daily)""",
    doubles="WS10_z",
)
def _(lake):
    daily = lake.met_daily()
    stats = grids.norm_stats(daily, ["WS10"])
    return grids.zscore_and_mask(daily, stats, ["WS10"]).select("sensor_id", "date", "WS10_valid", "WS10_z")


@query("log1p_target", "SELECT event_id, ln(1 + value) AS y, value AS back FROM events", doubles="y back")
def _(lake):
    y = F.log1p("pm25")
    return lake.readings().select("event_id", y.alias("y"), F.expm1(y).alias("back"))
