"""Domain tables (readings, stations, pixels, weather, predictions) derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .store import FeatureStore


_WRITTEN: dict[tuple[str, str], FeatureStore] = {}


class Lake:
    """The given Parquet tables of one folder, and the domain tables Spark derives from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def store(self) -> FeatureStore:
        """Feature store holding the daily tables by date; written once per application and folder."""
        slot = (self.spark.sparkContext.applicationId, self.folder)
        if slot not in _WRITTEN:
            store = FeatureStore(self.spark, scratch_path(self.spark, "store"))
            store.write("station", self.station_daily())
            store.write("met", self.met_daily())
            store.write("gas", self.gas_pixels())
            _WRITTEN[slot] = store
        return _WRITTEN[slot]

    def readings(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("sensor_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("pm25"),
            "event_type",
        )

    def _daily(self, day) -> DataFrame:
        """Daily means; a reading marked as an error counts as a row without a value."""
        valid = F.when(F.col("event_type") != "error", F.col("pm25"))
        daily = self.readings().groupBy("sensor_id", day.alias("date"))
        return daily.agg(F.avg(valid).alias("pm25"), F.count(F.lit(1)).alias("n"))

    def station_daily(self) -> DataFrame:
        return self._daily(F.to_date("ts"))

    def sparse_daily(self) -> DataFrame:
        """Sparse daily series: the days are pulled apart, so that gaps of none to several days are common."""
        pulled = ((F.day("ts") + F.col("sensor_id")) / 4).cast("int") * (F.col("sensor_id") % 4).cast("int")
        return self._daily(F.date_add(F.to_date("ts"), pulled))

    def skill_daily(self) -> DataFrame:
        """Daily series spread over the year by station, with the last third held out."""
        shift = (F.lit(30) * (F.col("sensor_id") % 12)).cast("int")
        day = F.to_date("ts")
        return (
            self.readings()
            .groupBy(
                "sensor_id",
                F.date_add(day, shift).alias("date"),
                (day <= F.lit("2024-01-20").cast("date")).alias("is_train"),
            )
            .agg(F.avg(F.when(F.col("event_type") != "error", F.col("pm25"))).alias("pm25"))
        )

    def yearly(self) -> DataFrame:
        """Daily series over seven calendar years."""
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("sensor_id"), F.to_date("o_orderdate").alias("date"))
            .agg(F.avg(F.col("o_totalprice") / 1000).alias("pm25"))
        )

    def stations(self) -> DataFrame:
        users = self.table("events").select(F.col("user_id").alias("sensor_id")).distinct()
        region = self.table("region").select(F.col("r_regionkey").cast("long").alias("_r"), F.col("r_name").alias("province"))
        s = F.col("sensor_id")
        return (
            users.withColumn("_r", s % 5)
            .join(region, "_r", "left")
            .select(
                "sensor_id",
                (F.lit(23.3) + (s * 37 % 141) * F.lit(0.1)).alias("lat"),
                (F.lit(60.5) + (s * 53 % 175) * F.lit(0.1)).alias("lon"),
                "province",
                F.when(s % 4 == 0, "regulatory").otherwise("lowcost").alias("provider"),
            )
        )

    def gas_pixels(self) -> DataFrame:
        line = self.table("lineitem")
        o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
        return line.groupBy(
            F.date_add(F.lit("2024-01-01").cast("date"), n).alias("date"),
            F.col("l_returnflag").alias("product"),
            (o % 40).alias("prow"),
            ((o * 7 + n * 13 + p) % 40).alias("pcol"),
        ).agg(
            F.avg(F.when(F.col("l_quantity") != 1, F.col("l_extendedprice"))).alias("value"),
            F.round(F.avg(1 - 3 * F.col("l_discount")), 9).alias("qa"),
        )

    def pixel_points(self) -> DataFrame:
        s = F.col("sensor_id")
        users = self.table("events").select(F.col("user_id").alias("sensor_id")).distinct()
        return users.select("sensor_id", (s * 11 % 40).alias("prow"), (s * 17 % 40).alias("pcol"))

    def met_readings(self) -> DataFrame:
        e = F.col("event_id")

        def known(c):
            return F.when(e % 17 != 0, c.cast("double"))

        return self.readings().select(
            "event_id",
            "sensor_id",
            "ts",
            known(F.col("pm25") / 10).alias("WS10"),
            known(100 + e * 37 % 900).alias("blh"),
            known(e * 13 % 101).alias("RH"),
            known(e * 29 % 360).alias("WD10"),
            known(90000 + e % 10000).alias("sp"),
            known(F.lit(273.15) + e % 40).alias("t2m"),
            known(F.lit(273.15) + e % 40 - e % 15).alias("d2m"),
        )

    def met_daily(self) -> DataFrame:
        names = ["WS10", "blh", "RH", "WD10", "sp", "t2m", "d2m"]
        daily = (
            self.met_readings()
            .groupBy("sensor_id", F.to_date("ts").alias("date"))
            .agg(*[F.avg(c).alias(c) for c in names])
        )
        return daily.withColumns(
            {
                "dT": F.col("t2m") - F.col("d2m"),
                "VC": F.col("WS10") * F.col("blh"),
                "VPD": F.col("RH") / 20,
                "dWS": F.col("WS10") / 4,
                "dWD": F.col("WD10") / 3 - 60,
                "BLH_tend": F.col("blh") / 24,
                "SP_tend": F.col("sp") / 240,
                "MSLP_tend": F.col("sp") / 300,
            }
        )

    def predictions(self) -> DataFrame:
        e = F.col("event_id")
        return self.readings().select(
            "event_id",
            "sensor_id",
            F.to_date("ts").alias("date"),
            F.col("pm25").alias("y_true"),
            (F.col("pm25") * 0.8 + 10 + (e % 7) * 3).alias("y_pred"),
            ((e % 12 + F.month("ts") - 1) % 12 + 1).cast("int").alias("month"),
            (e % 11).alias("iy"),
            (e % 13).alias("ix"),
        )

    def met_cube(self) -> DataFrame:
        """Daily coarse grid (11 x 13 cells over the domain) with some cells missing on some days."""
        e = F.col("event_id")
        return (
            self.readings()
            .groupBy(F.to_date("ts").alias("date"), (e % 11).alias("iy"), (e % 13).alias("ix"))
            .agg(F.avg("pm25").alias("value"))
        )

    def polygon_edges(self) -> DataFrame:
        """Four edges of a slanted quadrilateral per region, bottom edge first, counter-clockwise."""
        k = F.col("r_regionkey")
        left, right, up = F.lit(60.5), F.lit(60.8), F.lit(3.48)
        corner_x = F.array(left + up * k, left + up * (k + 1), right + up * (k + 1), right + up * k)
        corner_y = F.array(*[F.lit(v) for v in (23.3, 23.3, 37.3, 37.3)])
        region = self.table("region").withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(3))))
        nxt = (F.col("edge") + 1) % 4
        return region.select(
            k.alias("poly_id"),
            F.col("r_name").alias("name"),
            "edge",
            F.get(corner_x, F.col("edge")).alias("x1"),
            F.get(corner_y, F.col("edge")).alias("y1"),
            F.get(corner_x, nxt).alias("x2"),
            F.get(corner_y, nxt).alias("y2"),
        )
