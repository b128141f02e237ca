"""Registered queries: store scans, readers, writers and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import ensure_date_column
from ..operators import assemble, spatial
from ..session import scratch_path
from ..sources import readers
from ..sources.store import FeatureStore, lake_manifest, missing_dates, sync_plan
from .aggregates import _REQUIRED, _STAGES
from .registry import query


@query(
    "scan_date_range",
    "SELECT sensor_id, pm25, date FROM station_daily WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'",
    doubles="pm25",
)
def _(lake):
    return lake.store().read("station", "2024-01-10", "2024-01-19", columns=["sensor_id", "pm25", "absent"])


@query("scan_single_date", "SELECT sensor_id, date, WS10 FROM met_daily WHERE date = DATE '2024-01-15'", doubles="WS10")
def _(lake):
    return lake.store().read_date("met", "2024-01-15", ["sensor_id", "WS10"])


@query("list_dates", "SELECT DISTINCT date, min(date) OVER () AS first_date, max(date) OVER () AS last_date FROM met_daily")
def _(lake):
    store = lake.store()
    span = store.date_span("met").select(F.struct("first_date", "last_date")).scalar()
    return store.dates("met").withColumn("_s", span).select("date", "_s.*")


@query(
    "scan_all_stages",
    """SELECT 'station' AS stage, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM station_daily UNION ALL
    SELECT 'met', count(*), min(date), max(date) FROM met_daily UNION ALL SELECT 'gas', count(*), min(date), max(date) FROM gas_pixels""",
)
def _(lake):
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("stage", F.lit(s))
        for s, df in lake.store().read_all(["station", "met", "gas", "absent"]).items()
    ]
    return assemble.union_partitions(parts)


@query("scan_master_lake", "SELECT sensor_id, date, pm25, n FROM station_daily WHERE date >= DATE '2024-01-12'", doubles="pm25")
def _(lake):
    # the station stage doubles as a master that lies at the root itself
    master = FeatureStore(lake.spark, lake.store().path("station"))
    return master.read_master(start="2024-01-12").select("sensor_id", "date", "pm25", "n")


_OBS = """SELECT d.date AS date_utc, s.province AS City, 'st_' || d.sensor_id AS Name, s.lat AS latitude, s.lon AS longitude, d.pm25 AS pm25_daily_mean
  FROM station_daily d JOIN stations s USING (sensor_id)"""


def _station_table(lake):
    return lake.station_daily().join(lake.stations(), "sensor_id").select(
        "sensor_id",
        "date",
        F.col("province").alias("city_name"),
        F.concat(F.lit("st_"), F.col("sensor_id").cast("string")).alias("station_name"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        F.when(F.col("n") > 1, F.col("pm25")).alias("pm25_ugm3_mean"),
    )


@query("load_observations", _OBS + " WHERE d.n > 1 AND d.pm25 IS NOT NULL", doubles="latitude longitude pm25_daily_mean")
def _(lake):
    return readers.load_observations(_station_table(lake))


@query(
    "load_observations_csv",
    "SELECT event_id, CAST(ts AS DATE) AS date, value AS pm25 FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'",
    doubles="pm25",
)
def _(lake):
    path = scratch_path(lake.spark, "observations")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_utc")
    lake.readings().select("event_id", text, "pm25").write.option("header", True).csv(path)
    df = readers.load_observations_csv(lake.spark, path, "event_id LONG, date_utc STRING, pm25 DOUBLE", "2024-01-05", "2024-01-25")
    return df.select("event_id", "date", "pm25")


@query(
    "load_sensor_csv",
    """SELECT ('0x' || substr(sha1(printf('%.5f,%.5f', s.lat, s.lon)), 1, 8))::BIGINT AS sensor_id, CAST(e.ts AS DATE) AS "time", min(e.value) AS pm25
      FROM events e JOIN stations s ON s.sensor_id = e.user_id WHERE e.event_type <> 'error' GROUP BY 1, 2""",
    doubles="pm25",
)
def _(lake):
    path = scratch_path(lake.spark, "sensors")
    rows = lake.readings().join(lake.stations(), "sensor_id")
    pm = F.when(F.col("event_type") != "error", F.col("pm25").cast("string")).otherwise("bad")
    rows.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.col("lat").cast("string"), F.col("lon").cast("string"), pm.alias("pm"), "province"
    ).write.option("header", True).csv(path)
    schema = "when STRING, lat STRING, lon STRING, pm STRING, province STRING"
    df = readers.load_sensor_csv(lake.spark, path, schema, time="when", lat="lat", lon="lon", target="pm", names=["province"])
    return df.select("sensor_id", "time", "pm25")


@query(
    "scan_station_window",
    "SELECT sensor_id, date, pm25 FROM station_daily WHERE date BETWEEN DATE '2024-01-30' - 14 AND DATE '2024-01-30'",
    doubles="pm25",
)
def _(lake):
    return lake.store().read("station", "2024-01-16", "2024-01-30").select("sensor_id", "date", "pm25")


@query(
    "file_catalog",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderkey % 3 AS k FROM orders)
      SELECT kind, date, h, v, min(path) AS path, count(*) AS n_files FROM (SELECT CASE k WHEN 0 THEN 'tile' WHEN 1 THEN 'day' ELSE 'month' END AS kind,
        CASE k WHEN 2 THEN date_trunc('month', date)::DATE ELSE date END AS date, CASE WHEN k = 0 THEN (20 + o_orderkey % 6)::INTEGER END AS h,
        CASE WHEN k = 0 THEN (4 + o_orderkey % 3)::INTEGER END AS v,
        CASE k WHEN 0 THEN format('lake/AOD.A{}.h{:02d}v{:02d}.061.{}.hdf', strftime(date, '%Y%j'), 20 + o_orderkey % 6, 4 + o_orderkey % 3, o_orderkey)
          WHEN 1 THEN format('lake/no2_{}_{}.tif', strftime(date, '%Y-%m-%d'), o_orderkey) ELSE format('lake/{}/features_{}.nc', o_orderkey, strftime(date, '%Y_%m')) END AS path FROM d) GROUP BY 1, 2, 3, 4""",
)
def _(lake):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    tile = F.concat(
        F.lit("lake/AOD.A"), F.date_format(d, "yyyyDDD"), F.lit(".h"), F.lpad((20 + k % 6).cast("string"), 2, "0"),
        F.lit("v"), F.lpad((4 + k % 3).cast("string"), 2, "0"), F.lit(".061."), k.cast("string"), F.lit(".hdf"),
    )
    day = F.concat(F.lit("lake/no2_"), F.date_format(d, "yyyy-MM-dd"), F.lit("_"), k.cast("string"), F.lit(".tif"))
    month = F.concat(F.lit("lake/"), k.cast("string"), F.lit("/features_"), F.date_format(d, "yyyy_MM"), F.lit(".nc"))
    paths = lake.table("orders").select(F.when(k % 3 == 0, tile).when(k % 3 == 1, day).otherwise(month).alias("path"))
    return readers.file_catalog(paths)


@query(
    "granule_manifest",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'G' || doc_id ELSE text END AS title, 'N-' || doc_id AS native_id, source AS short_name, lang AS version, '2024-01-01T00:00:00Z' AS begin_datetime,
    NULL::VARCHAR AS end_datetime, (doc_id % 4)::INTEGER AS n_related_urls FROM documents""",
)
def _(lake):
    d = F.col("doc_id").cast("string")
    urls = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda i: F.struct(F.when(i > 0, F.concat(F.lit("u"), i.cast("string"))).alias("URL")))
    doc = F.struct(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("G"), d)).alias("GranuleUR"),
        F.col("text").alias("Title"),
        F.concat(F.lit("N-"), d).alias("NativeId"),
        F.struct(F.struct(F.lit("2024-01-01T00:00:00Z").alias("BeginningDateTime")).alias("RangeDateTime")).alias("TemporalExtent"),
        F.struct(F.col("source").alias("ShortName"), F.col("lang").alias("Version")).alias("CollectionReference"),
        urls.alias("RelatedUrls"),
    )
    return readers.granule_manifest(lake.table("documents").select(F.to_json(doc).alias("text")))


@query(
    "quality_json_flatten",
    """SELECT date, 6 AS total_features, 1 AS missing_features, 5 AS available_features, count(*) AS country_cells,
    round(avg((coalesce(WS10, blh, RH) IS NOT NULL)::INTEGER), 4) AS met_coverage, 3 AS met_features FROM met_daily GROUP BY 1""",
    doubles="met_coverage",
)
def _(lake):
    report = assemble.data_quality_report(lake.met_daily(), _STAGES, _REQUIRED, F.lit(True))
    path = scratch_path(lake.spark, "quality")
    # one JSON file per day with the day in its folder's name
    report.withColumnRenamed("country_cells", readers.CELLS_FIELD).repartition("date").write.partitionBy("date").json(path)
    flat = assemble.flatten_quality(readers.read_quality_documents(lake.spark, path), list(_STAGES))
    return flat.select(
        "date", "total_features", "missing_features", "available_features",
        F.col("country_cells").cast("long").alias("country_cells"), "met_coverage", "met_features",
    )


@query(
    "write_date_partitions",
    "SELECT date, count(*) AS n, avg(CASE WHEN date < DATE '2024-01-16' THEN pm25 ELSE pm25 + 1000 END) AS mean FROM station_daily GROUP BY 1",
    doubles="mean",
)
def _(lake):
    store = FeatureStore(lake.spark, scratch_path(lake.spark, "written"))
    daily = lake.station_daily()
    store.write("s", daily.where("date < '2024-01-16'"))
    # dates that are there are skipped, so only the later ones carry the shifted values
    store.write("s", daily.withColumn("pm25", F.col("pm25") + 1000))
    return store.read("s").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "write_single_date",
    "SELECT date, count(*) AS n, avg(CASE WHEN date = DATE '2024-01-10' THEN -1 ELSE pm25 END) AS mean FROM station_daily GROUP BY 1",
    doubles="mean",
)
def _(lake):
    store = FeatureStore(lake.spark, scratch_path(lake.spark, "single"))
    daily = lake.station_daily()
    store.write("s", daily)
    one = daily.where("date = '2024-01-10'").withColumn("pm25", F.lit(-1.0))
    store.write("s", one, overwrite=True)
    return store.read("s").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean"))


@query(
    "write_grid_partitions",
    "SELECT date, count(*) AS n_rows FROM met_cube GROUP BY 1 HAVING count(*) <> 142",
)
def _(lake):
    store = FeatureStore(lake.spark, scratch_path(lake.spark, "grid"))
    cells = lake.met_cube().withColumns({"lat": 37.3 - 1.4 * F.col("iy"), "lon": 60.5 + 1.45 * F.col("ix")})
    return store.write_grid("cells", cells, expected_rows=142).withColumnRenamed("count", "n_rows")


@query(
    "ensure_date_column",
    "SELECT event_id, CAST(ts AS DATE) AS date FROM events UNION ALL SELECT o_orderkey + 100000000, CAST(o_orderdate AS DATE) FROM orders",
)
def _(lake):
    a = ensure_date_column(lake.table("events")).select("event_id", "date")
    b = ensure_date_column(lake.table("orders").withColumnRenamed("o_orderdate", "time"))
    return a.unionByName(b.select((F.col("o_orderkey") + 100000000).alias("event_id"), "date"))


@query(
    "write_master",
    "SELECT fmt, sensor_id, date, pm25, n FROM station_daily, (VALUES ('parquet'), ('csv'), ('lake')) v(fmt)",
    doubles="pm25",
    digits=9,
)
def _(lake):
    store = FeatureStore(lake.spark, scratch_path(lake.spark, "master"))
    daily = lake.store().read("station")
    store.write_table("parquet", daily)
    store.write_table("csv", daily, "csv")
    store.write("lake", daily)
    back = {
        "parquet": lake.spark.read.parquet(store.path("parquet")),
        "csv": lake.spark.read.schema(daily.schema).option("header", True).csv(store.path("csv")),
        "lake": store.read("lake"),
    }
    parts = [df.select(F.lit(f).alias("fmt"), "sensor_id", "date", "pm25", "n") for f, df in back.items()]
    return assemble.union_partitions(parts)


@query(
    "missing_dates",
    "SELECT sensor_id, date, pm25 FROM station_daily WHERE date NOT IN (SELECT date FROM station_daily GROUP BY 1 HAVING max(pm25) >= 180)",
    doubles="pm25",
)
def _(lake):
    daily = lake.station_daily().drop("n")
    done = daily.groupBy("date").agg(F.max("pm25").alias("top")).where("top >= 180")
    return missing_dates(daily, done)


@query(
    "incremental_sync_plan",
    """WITH r AS (SELECT DISTINCT o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'),
      l AS (SELECT DISTINCT o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'F')
      SELECT r.dataset, count(*) - count(l.date) AS to_sync, count(l.date) AS skipped FROM r LEFT JOIN l ON l.dataset = r.dataset AND l.date = r.date GROUP BY 1""",
)
def _(lake):
    o = lake.table("orders").select(F.col("o_orderpriority").alias("dataset"), F.to_date("o_orderdate").alias("date"), "o_orderstatus")
    return sync_plan(o, o.where("o_orderstatus = 'F'"), "1996-01-01", "1999-12-31")


@query(
    "lake_manifest",
    """SELECT o_orderpriority AS dataset, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_partitions, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def _(lake):
    name = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate").cast("string")).otherwise("_tmp")
    parts = lake.table("orders").select(F.col("o_orderpriority").alias("dataset"), name.alias("partition"))
    return lake_manifest(parts)


@query(
    "static_grid",
    """WITH g AS (SELECT r, c, round(37.3::DOUBLE - 0.1::DOUBLE*r, 6) AS lat, round(60.5::DOUBLE + 0.1::DOUBLE*c, 6) AS lon FROM range(141) a(r), range(175) b(c)),
      s AS (SELECT greatest(0, least(140, round_even((lat - 37.3::DOUBLE)/(-0.1::DOUBLE), 0)))::INTEGER AS r, greatest(0, least(174, round_even((lon - 60.5::DOUBLE)/0.1::DOUBLE, 0)))::INTEGER AS c, count(*) AS n FROM stations GROUP BY 1, 2)
      SELECT g.r::INTEGER AS row, g.c::INTEGER AS col, lat, lon, printf('%.2f_%.2f', lat, lon) AS cell_id, coalesce(s.n, 0) AS n_stations FROM g LEFT JOIN s ON s.r = g.r AND s.c = g.c""",
    doubles="lat lon",
)
def _(lake):
    placed = spatial.nearest_grid_cell(lake.stations(), spatial.GRID_LAT, spatial.GRID_LON)
    counts = placed.groupBy(F.col("iy").alias("row"), F.col("ix").alias("col")).agg(F.count(F.lit(1)).alias("n_stations"))
    cells = spatial.static_grid(lake.spark).join(counts, ["row", "col"], "left")
    return cells.na.fill(0, ["n_stations"])


@query(
    "export_predictions_csv",
    "SELECT date, round(37.3::DOUBLE - 1.4*iy, 4) AS lat, round(60.5::DOUBLE + 1.45*ix, 4) AS lon, value AS pm25 FROM met_cube",
    doubles="lat lon pm25",
)
def _(lake):
    store = FeatureStore(lake.spark, scratch_path(lake.spark, "export"))
    cells = lake.met_cube().select(
        "date", F.round(37.3 - 1.4 * F.col("iy"), 4).alias("lat"), F.round(60.5 + 1.45 * F.col("ix"), 4).alias("lon"), F.col("value").alias("pm25")
    )
    store.write_table("predictions", cells, "csv")
    return lake.spark.read.schema(cells.schema).option("header", True).csv(store.path("predictions"))
