"""Readers for observations, sensor files, path catalogues and JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import sensor_id, sensor_slug
from ..functions.timecols import normalize_time_utc
from ..operators.assemble import dedup_first
from ..semantics import coerce_numeric

OBSERVATION_COLUMNS = {
    "date": "date_utc",
    "city_name": "City",
    "station_name": "Name",
    "latitude": "latitude",
    "longitude": "longitude",
    "pm25_ugm3_mean": "pm25_daily_mean",
}


def load_observations(station_daily: DataFrame) -> DataFrame:
    """Six standard columns of a station table, rows without a target dropped."""
    return station_daily.select(*[F.col(a).alias(b) for a, b in OBSERVATION_COLUMNS.items()]).where(
        F.col("pm25_daily_mean").isNotNull()
    )


def load_observations_csv(spark: SparkSession, path: str, schema: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV rows with a date from ``date_utc`` or ``date``, within an inclusive range."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    source = "date_utc" if "date_utc" in df.columns else "date"
    df = df.withColumn("date", normalize_time_utc(F.col(source)))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def clean_sensor_rows(df: DataFrame, time: str, lat: str, lon: str, target: str, names: Sequence[str] = ()) -> DataFrame:
    """UTC day, numbers, station id and slug; incomplete rows and repeated (station, day) rows go.

    The smallest target wins among repeats, so that the result does not depend on file order.
    """
    missing = [c for c in (time, lat, lon, target) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    y, x = coerce_numeric(F.col(lat)), coerce_numeric(F.col(lon))
    out = df.select(
        sensor_id(y, x).alias("sensor_id"),
        sensor_slug(*[F.col(n) for n in names], lat=y, lon=x).alias("sensor_name"),
        normalize_time_utc(F.col(time)).alias("time"),
        y.alias("latitude"),
        x.alias("longitude"),
        coerce_numeric(F.col(target)).alias("pm25"),
    ).na.drop(subset=["time", "latitude", "longitude", "pm25"])
    return dedup_first(out, ["sensor_id", "time"], ["pm25", "sensor_name"])


def load_sensor_csv(spark: SparkSession, path: str, schema: str, **columns) -> DataFrame:
    return clean_sensor_rows(spark.read.schema(schema).option("header", True).csv(path), **columns)


# File-name patterns of the three products
TILE_NAME = r"A(\d{4})(\d{3})\.h(\d{2})v(\d{2})\."
DAY_NAME = r"(\d{4})-(\d{2})-(\d{2})"
MONTH_NAME = r"features_(\d{4})_(\d{2})\.nc$"


def path_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder; the file contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    )


def file_catalog(paths: DataFrame, path: str = "path") -> DataFrame:
    """Product kind, date and tile of each path by its name; the first path per key stays."""
    p = F.col(path)

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(p, pattern, i)

    tile, day, month = p.rlike(TILE_NAME), p.rlike(DAY_NAME), p.rlike(MONTH_NAME)
    year_start = F.to_date(F.concat(part(TILE_NAME, 1), F.lit("-01-01")))
    date = (
        F.when(tile, F.date_add(year_start, F.nullif(part(TILE_NAME, 2), F.lit("")).cast("int") - 1))
        .when(month, F.try_to_date(F.concat_ws("-", part(MONTH_NAME, 1), part(MONTH_NAME, 2), F.lit("01"))))
        .when(day, F.try_to_date(F.concat_ws("-", part(DAY_NAME, 1), part(DAY_NAME, 2), part(DAY_NAME, 3))))
    )
    kind = F.when(tile, "tile").when(month, "month").when(day, "day")
    out = paths.select(
        kind.alias("kind"),
        date.alias("date"),
        F.when(tile, part(TILE_NAME, 3).cast("int")).alias("h"),
        F.when(tile, part(TILE_NAME, 4).cast("int")).alias("v"),
        p.alias("path"),
    ).where("kind IS NOT NULL AND date IS NOT NULL")
    return out.groupBy("kind", "date", "h", "v").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_files"))


def granule_manifest(documents: DataFrame, text: str = "text") -> DataFrame:
    """Flat rows from granule metadata documents: title, native id, time range, number of links."""
    j = F.from_json(
        F.col(text),
        """GranuleUR STRING, Title STRING, NativeId STRING,
        TemporalExtent STRUCT<RangeDateTime: STRUCT<BeginningDateTime: STRING, EndingDateTime: STRING>>,
        CollectionReference STRUCT<ShortName: STRING, Version: STRING>,
        RelatedUrls ARRAY<STRUCT<URL: STRING>>""",
    )
    span = "_j.TemporalExtent.RangeDateTime"
    return documents.withColumn("_j", j).select(
        F.coalesce("_j.GranuleUR", "_j.Title").alias("title"),
        F.col("_j.NativeId").alias("native_id"),
        F.col("_j.CollectionReference.ShortName").alias("short_name"),
        F.col("_j.CollectionReference.Version").alias("version"),
        F.col(f"{span}.BeginningDateTime").alias("begin_datetime"),
        F.col(f"{span}.EndingDateTime").alias("end_datetime"),
        F.coalesce(F.size(F.filter("_j.RelatedUrls", lambda u: u["URL"] != "")), F.lit(0)).alias("n_related_urls"),
    )


# Fields of a published quality document
CELLS_FIELD = "pakistan_cells"
QUALITY_SCHEMA = (
    "total_features INT, missing_features INT, available_features INT, nan_fraction DOUBLE, pakistan_cells INT, "
    "stage_coverage MAP<STRING, DOUBLE>, stage_nan_fraction MAP<STRING, DOUBLE>, stage_feature_count MAP<STRING, INT>"
)


def read_quality_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per-day quality documents with the day taken from the file name, else from the folder's."""
    raw = spark.read.schema(QUALITY_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    own, folder = (F.nullif(F.regexp_extract(F.col(f"_metadata.{c}"), DAY_NAME, 0), F.lit("")) for c in ("file_name", "file_path"))
    day = F.coalesce(own, folder)
    return raw.select(F.try_to_date(day).alias("date"), "*").withColumnRenamed(CELLS_FIELD, "country_cells")
