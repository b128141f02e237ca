"""Station network analysis: quality-controlled days, activity, growth and neighbours' history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import MIN_VALID_HOURS
from .nearby import near_sums
from .quantile import exact_quantiles
from .temporal import series


def hourly_readings(df: DataFrame, key: str = "sensor_id", time: str = "ts", value: str = "pm25") -> DataFrame:
    """One row per station and hour; repeated readings of an hour are averaged (combines map-side)."""
    return df.groupBy(key, F.date_trunc("hour", time).alias("hour")).agg(F.avg(value).alias(value))


def quality_control(
    hourly: DataFrame,
    key: str = "sensor_id",
    value: str = "pm25",
    low: float = 0.0,
    high: float = 1000.0,
    sentinels: Sequence[float] = (-999.0, 985.0),
    max_step: float = 500.0,
    flat_run: int = 4,
) -> DataFrame:
    """NULL out impossible, sentinel, spiking and flat-lining hours.

    The bounds are this package's own defaults; hourly rows are unique per (key, hour).
    """
    v = F.when(F.col(value).between(low, high) & ~F.col(value).isin(list(sentinels)), F.col(value))
    w = series(key, "hour")
    spike = (F.abs(F.col("_v") - F.lag("_v").over(w)) > max_step) & (F.abs(F.col("_v") - F.lead("_v").over(w)) > max_step)
    frame = w.rowsBetween(-(flat_run - 1), 0)
    flat = (
        (F.count("_v").over(frame) == flat_run)
        & (F.max("_v").over(frame) == F.min("_v").over(frame))
    )
    keep = ~F.coalesce(spike, F.lit(False)) & ~F.coalesce(flat, F.lit(False))
    return hourly.withColumn("_v", v).withColumn(value, F.when(keep, F.col("_v"))).drop("_v")


def hourly_to_daily(hourly: DataFrame, key: str = "sensor_id", value: str = "pm25", min_hours: int = MIN_VALID_HOURS):
    """Daily mean, median and 95th percentile of the valid hours, and whether the day is complete.

    A day has at most 24 hourly rows, so the percentiles are bounded.
    """
    n = F.count(value)
    return hourly.groupBy(key, F.to_date("hour").alias("date")).agg(
        F.avg(value).alias("pm25_mean"),
        F.percentile(value, 0.5).alias("pm25_median"),
        F.percentile(value, 0.95).alias("pm25_p95"),
        n.alias("n_hours_valid"),
        (n >= min_hours).cast("int").alias("complete"),
    )


def daily_mean_max_min(df: DataFrame, variables: Sequence[str], key: str = "sensor_id", time: str = "ts") -> DataFrame:
    stats = {"mean": F.avg, "max": F.max, "min": F.min}
    return df.groupBy(key, F.to_date(time).alias("date")).agg(
        *[f(v).alias(f"{v}_daily_{s}") for v in variables for s, f in stats.items()]
    )


def station_activity(
    daily: DataFrame, reference: str, window_days: int = 30, min_valid_days: int = 10, min_hours: int = MIN_VALID_HOURS,
    key: str = "sensor_id",
) -> DataFrame:
    """Presence and validity per station over the window before the reference date.

    ``daily`` has (key, date, pm25, valid_hours, lat, lon, province, provider).
    """
    end = F.lit(reference).cast("date")
    window = daily.where(F.col("date").between(F.date_sub(end, window_days), end))
    valid = F.col("pm25").isNotNull() & (F.col("valid_hours") >= min_hours)
    first = [F.min_by(c, "date").alias(c) for c in ("lat", "lon", "province", "provider")]
    out = window.groupBy(key).agg(
        *first,
        F.countDistinct("date").alias("days_present"),
        F.sum(F.coalesce(valid, F.lit(False)).cast("int")).alias("valid_days"),
        F.avg("pm25").alias("mean_pm25"),
        F.avg("valid_hours").alias("mean_valid_hours"),
    )
    return out.withColumn("active", (F.col("valid_days") >= min_valid_days).cast("int"))


def network_growth(daily: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Distinct stations reporting on each 1 January and 1 July inside the data's range."""
    sampled = (F.month("date").isin(1, 7)) & (F.dayofmonth("date") == 1)
    return daily.where(sampled).groupBy("date").agg(F.countDistinct(key).alias("n_stations"))


def active_by_region(activity: DataFrame, region: str = "province") -> DataFrame:
    return activity.where("active = 1").groupBy(region).agg(F.count(F.lit(1)).alias("n_active"))


def provider_summary(activity: DataFrame, daily: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Stations per provider, and valid hours averaged over the provider's station-days."""
    stations = activity.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("active").alias("active"),
        F.sum(1 - F.col("active")).alias("inactive"),
    )
    hours = (
        daily.join(activity.select(key, F.col("provider").alias("_p")), key)
        .groupBy(F.col("_p").alias("provider"))
        .agg(F.avg("valid_hours").alias("mean_valid_hours"))
    )
    return stations.join(hours, "provider", "left")


def active_bounds(activity: DataFrame) -> DataFrame:
    return activity.where("active = 1").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    )


def network_by_era(daily: DataFrame, eras: Sequence[tuple[int, int]], key: str = "sensor_id") -> DataFrame:
    """Distinct stations per block of years."""
    year = F.year("date")
    era = F.lit(None).cast("string")
    for first, last in eras:
        era = F.when(year.between(first, last), f"{first}-{last}").otherwise(era)
    return daily.withColumn("era", era).where("era IS NOT NULL").groupBy("era").agg(F.countDistinct(key).alias("n_stations"))


def overlap_dates(observations: DataFrame, imagery: DataFrame) -> DataFrame:
    """Observation days, those with imagery, and the share in percent."""
    days = observations.select("date").distinct()
    have = imagery.select("date").distinct().withColumn("_have", F.lit(1))
    both = days.join(have, "date", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("_have").alias("n_overlap"),
        F.try_divide(100.0 * F.count("_have"), F.count(F.lit(1))).alias("overlap_pct"),
    )


def monitor_history(
    daily: DataFrame, sites: DataFrame, radius_km: float, max_lag_days: int = 3, key: str = "sensor_id", target: str = "pm25"
) -> DataFrame:
    """Own values 1..n calendar days back and the mean of the other stations nearby on those days.

    The neighbour mean leaves the station itself out: it is the sum around the station's place (``nearby.near_sums``)
    less the station's own part. (key, date) is unique.
    """
    v = F.col(target).cast("double")
    inf = float("inf")
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf), v)
    # sums and numbers of values; those that no sum can hold are counted
    parts = {
        "_total": F.coalesce(finite, F.lit(0.0)), "_n": v.isNotNull().cast("int"), "_nan": F.coalesce(F.isnan(v), F.lit(False)).cast("int"),
        "_up": F.coalesce(v == inf, F.lit(False)).cast("int"), "_down": F.coalesce(v == -inf, F.lit(False)).cast("int"),
        "_rows": F.lit(1),
    }
    placed = daily.select(key, "date", target, *[c.alias(n) for n, c in parts.items()]).join(
        sites.select(key, "lat", "lon"), key, "left"
    )
    day = F.unix_date("date")

    def back(window, k: int):
        return window.orderBy(day).rangeBetween(-k, -k)

    own = Window.partitionBy(key)
    lags = range(1, max_lag_days + 1)
    mine = placed.select(
        key, "date", "lat", "lon",
        *[F.max(target).over(back(own, k)).alias(f"{target}_own_lag{k}") for k in lags],
        *[
            F.coalesce(F.sum(n).over(back(own, k)), F.lit(0)).cast("double").alias(f"_own{n}{k}") for k in lags for n in parts
        ],
    )
    # the days looked back at are asked for at each place, whether it has rows on them or not
    asked = placed.select("lat", "lon", "date").distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max_lag_days))))
    asked = asked.select("lat", "lon", F.date_sub("date", F.col("_k")).alias("date"), *[F.lit(0).cast(placed.schema[n].dataType).alias(n) for n in parts])
    around = near_sums(placed.select("lat", "lon", "date", *parts).union(asked), radius_km, list(parts))
    place = Window.partitionBy("lat", "lon")
    around = around.select("lat", "lon", "date", *[F.max(n).over(back(place, k)).alias(f"_near{n}{k}") for k in lags for n in parts])
    both = mine.join(around, ["lat", "lon", "date"], "left")

    def others(n: str, k: int) -> Column:
        return F.col(f"_near{n}{k}") - F.col(f"_own{n}{k}")

    def mean(k: int) -> Column:
        nan = (others("_nan", k) > 0) | ((others("_up", k) > 0) & (others("_down", k) > 0))
        total = F.when(nan, float("nan")).when(others("_up", k) > 0, inf).when(others("_down", k) > 0, -inf).otherwise(others("_total", k))
        return F.when(others("_n", k) > 0, total / others("_n", k))

    lagged = both.select(
        key, "date",
        *[f"{target}_own_lag{k}" for k in lags],
        *[mean(k).alias(f"{target}_near_lag{k}") for k in lags],
        F.when(others("_rows", 1) > 0, others("_n", 1).cast("long")).alias("n_near_lag1"),
    )
    return daily.join(lagged, [key, "date"], "left")


def balanced_weights(df: DataFrame, group: str = "province", key: str = "sensor_id", clip: float = 0.99) -> DataFrame:
    """Inverse square roots of group and station sizes, clipped at a quantile, averaging one."""
    per_station = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("_ns"))
    per_group = per_station.groupBy(group).agg(F.sum("_ns").alias("_ng"))
    sizes = per_station.join(per_group, group).withColumn("_w", 1.0 / F.sqrt("_ng") * (1.0 / F.sqrt("_ns")))
    # a station's rows all weigh the same, so the quantile over rows comes from one row per station
    cap = exact_quantiles(sizes, [], "_w", {"cap": clip}, weight="_ns").select("cap").scalar()
    clipped = sizes.withColumn("_w", F.least(F.col("_w"), cap))
    mean = clipped.agg(F.sum(F.col("_w") * F.col("_ns")) / F.sum("_ns")).scalar()
    return df.join(clipped.select(group, key, (F.col("_w") / mean).alias("weight")), [group, key])


def coverage_by_province(df: DataFrame, availability: dict[str, Sequence[str]], means: Sequence[str], by: str = "province"):
    """Share of rows (percent) with any value of each product, and plain means."""
    shares = []
    for product, columns in availability.items():
        any_value = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
        shares.append((100.0 * F.avg(any_value.cast("double"))).alias(f"{product}_available_pct"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *shares, *[F.avg(c).alias(f"mean_{c}") for c in means])


def provider_dimension(daily: DataFrame, lat: str = "lat", lon: str = "lon", decimals: int = 5) -> DataFrame:
    """Latest provider name of each coordinate."""
    return daily.groupBy(F.round(lat, decimals).alias(lat), F.round(lon, decimals).alias(lon)).agg(
        F.max_by("provider", F.struct("date", "provider")).alias("provider")
    )


def provider_tag(df: DataFrame, providers: DataFrame, key: str, regulatory: str) -> DataFrame:
    """Provider per row with an 'Unknown' default and the regulatory flag."""
    name = F.coalesce("provider", F.lit("Unknown"))
    return df.join(providers.select(key, "provider"), key, "left").withColumns(
        {"provider": name, "is_regulatory": (name == regulatory).cast("int")}
    )


def split_by_provider(df: DataFrame, regulatory: Column) -> tuple[DataFrame, DataFrame]:
    """(regulatory, low-cost) parts; emptiness is the caller's check, since it costs an action."""
    return df.where(regulatory), df.where(~regulatory)


def ranked(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows in an explicit order, with their rank; only n rows reach the window."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
