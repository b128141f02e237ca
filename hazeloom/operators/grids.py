"""Weather cubes and gridded daily products: time handling, flags, summaries and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import AQI_CATEGORY_LABELS, NODATA
from ..functions.aqi import aqi_category, aqi_category_label
from .quantile import exact_quantiles
from .temporal import series


def unfold_valid_time(df: DataFrame, keys: Sequence[str], variables: Sequence[str], prefer: str = "first_valid") -> DataFrame:
    """Base time plus step (hours) becomes the valid time; several leads of one time are reduced."""
    valid = F.timestamp_add("HOUR", F.col("step"), F.col("time"))
    picks = {
        "first_valid": lambda v: F.min_by(v, F.when(F.col(v).isNotNull(), F.col("step"))),
        "first": lambda v: F.min_by(v, "step"),
        "mean": F.avg,
        "median": lambda v: F.percentile(v, 0.5),
    }
    pick = picks[prefer]
    return df.groupBy(valid.alias("valid_time"), *keys).agg(*[pick(v).alias(v) for v in variables])


def fill_bad_first_hour(df: DataFrame, keys: Sequence[str], time: str, variables: Sequence[str], limit: float = 0.999) -> DataFrame:
    """Copies the second time step over the first where the first is all but empty."""
    first = df.agg(F.min(time)).scalar()
    bad = df.where(F.col(time) == first).agg(
        F.greatest(*[F.avg(F.col(v).isNull().cast("double")) for v in variables], F.lit(0.0))
    ).scalar()
    w = Window.partitionBy(*keys).orderBy(time)
    patch = (F.col(time) == first) & (bad > limit)
    return df.withColumns({v: F.when(patch, F.lead(v).over(w)).otherwise(F.col(v)) for v in variables})


def clamp_to_month(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows of the month most time steps fall in; the earlier month wins a tie."""
    month = F.date_trunc("month", F.col(time))
    steps = df.select(F.col(time).alias("_t")).distinct().groupBy(F.date_trunc("month", "_t").alias("_m")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    modal = steps.agg(F.min_by("_m", F.struct(-F.col("_n"), F.col("_m")))).scalar()
    return df.where(month == modal)


def intersect_hours(a: DataFrame, b: DataFrame, time: str = "ts") -> DataFrame:
    """Hours (rounded) present in both tables."""

    def hours(df: DataFrame) -> DataFrame:
        rounded = F.date_trunc("hour", F.col(time) + F.expr("INTERVAL 30 MINUTES"))
        return df.select(rounded.alias("hour")).distinct()

    return hours(a).join(hours(b), "hour", "left_semi")


def daily_midnight_snapshot(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Value at each midnight between the first and last reading, linear in time, nearest at the ends.

    Every gap between neighbouring readings yields the midnights it covers, so one sort per key is all
    that is needed; readings are unique per (key, time).
    """
    w = series(key, time)
    t, v = F.col(time), F.col(value)
    nxt_t, nxt_v = F.lead(time).over(w), F.lead(value).over(w)
    day = F.expr("INTERVAL 1 DAY")
    spans = df.select(key, t.alias("_t0"), v.alias("_v0"), nxt_t.alias("_t1"), nxt_v.alias("_v1"), F.lag(time).over(w).alias("_tp"))
    floor0 = F.date_trunc("day", "_t0")
    first = F.when(floor0 == F.col("_t0"), floor0).otherwise(floor0 + day)
    inner = (
        spans.where(F.col("_t1").isNotNull())
        .withColumn("_first", first)
        .where(F.col("_first") < F.col("_t1"))
        .withColumn("_m", F.explode(F.sequence("_first", F.col("_t1"), day)))
        .where((F.col("_m") >= F.col("_t0")) & (F.col("_m") < F.col("_t1")))
    )
    span = F.unix_micros("_t1") - F.unix_micros("_t0")
    part = (F.unix_micros("_m") - F.unix_micros("_t0")) / span
    inside = inner.select(key, F.to_date("_m").alias("date"), (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part).alias(value))
    start = spans.where(F.col("_tp").isNull() & (floor0 < F.col("_t0"))).select(
        key, F.to_date("_t0").alias("date"), F.col("_v0").alias(value)
    )
    end = spans.where(F.col("_t1").isNull() & (floor0 == F.col("_t0"))).select(
        key, F.to_date("_t0").alias("date"), F.col("_v0").alias(value)
    )
    return inside.unionByName(start).unionByName(end)


def mixing_features(df: DataFrame, cell: str, month: Column, ws: str = "WS10", blh: str = "blh") -> DataFrame:
    """Ventilation coefficient and its robust index per cell and month (median, quartile range, clipped at 3)."""
    out = df.withColumns({"VC": F.col(ws) * F.col(blh), "_month": month})
    quartiles = exact_quantiles(out, [cell, "_month"], "VC", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    index = F.when(iqr > 0, (F.col("VC") - F.col("_q2")) / iqr)
    clipped = F.when(index < -3, -3.0).when(index > 3, 3.0).otherwise(index)
    return out.join(quartiles, [cell, "_month"], "left").withColumn("VCi", clipped).drop("_q1", "_q2", "_q3", "_month")


def regime_flags(df: DataFrame, inside: str, vc: str = "VC", rh: str = "RH", vc_quantile: float = 0.4, rh_limit: float = 85.0):
    """Stagnant below the in-country quantile of VC, humid above the limit, -1 outside the country."""
    limit = exact_quantiles(df.where(inside), [], vc, {"q": vc_quantile}).select("q").scalar()
    stagnant = F.coalesce(F.col(vc) < limit, F.lit(False)).cast("int")
    humid = F.coalesce(F.col(rh) > rh_limit, F.lit(False)).cast("int")
    return df.withColumns(
        {
            "Stagnant": F.when(F.col(inside), stagnant).otherwise(-1),
            "HighRH": F.when(F.col(inside), humid).otherwise(-1),
        }
    )


def grid_day_stats(df: DataFrame, value: str = "pm25", date: str = "date") -> DataFrame:
    """Daily mean, median, extremes, tails and counts; the quantiles are exact for any number of cells."""
    plain = df.groupBy(date).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
        F.count(value).alias("n_valid"),
        F.count(F.lit(1)).alias("n_total"),
    )
    tails = exact_quantiles(df, [date], value, {"median": 0.5, "p05": 0.05, "p95": 0.95})
    return plain.join(tails, date, "left")


def aqi_day_summary(df: DataFrame, value: str = "pm25", date: str = "date") -> DataFrame:
    """Day statistics with the shares of clean and unhealthy cells, in percent."""
    v = F.col(value)
    plain = df.where(v.isNotNull()).groupBy(date).agg(
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.stddev_pop(v).alias("std"),
        (100.0 * F.avg((v < 9.0).cast("double"))).alias("good_pct"),
        (100.0 * F.avg((v > 55.4).cast("double"))).alias("unhealthy_pct"),
    )
    return plain.join(exact_quantiles(df, [date], value, {"median": 0.5, "p95": 0.95}), date, "left")


def aqi_category_share(df: DataFrame, value: str = "pm25", date: str = "date") -> DataFrame:
    """Percent of cells per category and the worst category present."""
    category = aqi_category(F.col(value))
    shares = [
        (100.0 * F.avg((F.col("_cat") == i).cast("double"))).alias(f"pct_{i}") for i in range(len(AQI_CATEGORY_LABELS))
    ]
    out = df.withColumn("_cat", category).where("_cat IS NOT NULL").groupBy(date).agg(
        *shares, F.max("_cat").alias("_worst"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("worst", aqi_category_label(F.col("_worst"))).drop("_worst")


def frame_scale(df: DataFrame, low: float, high: float, value: str = "pm25", date: str = "date") -> DataFrame:
    """Colour range per day: first to 99th percentile kept inside the given bounds, which also serve
    where a day has no spread; the extremes of the whole period come along."""
    tails = exact_quantiles(df, [date], value, {"p01": 0.01, "p99": 0.99, "_lo": 0.0, "_hi": 1.0})
    vmin, vmax = F.greatest(F.lit(low), F.col("p01")), F.least(F.lit(high), F.col("p99"))
    usable = (F.col("p99") > F.col("p01")) & (vmax > vmin)
    # one row per day from here on
    period = Window.partitionBy()
    return tails.select(
        date,
        F.when(usable, vmin).otherwise(low).alias("vmin"),
        F.when(usable, vmax).otherwise(high).alias("vmax"),
        F.min("_lo").over(period).alias("period_min"),
        F.max("_hi").over(period).alias("period_max"),
    )


def norm_stats(df: DataFrame, features: Sequence[str], date: str = "date", n_dates: int | None = None, binary: Sequence[str] = ()):
    """Mean and deviation per feature as rows, over all dates or ``n_dates`` evenly spaced ones; flags keep (0, 1)."""
    if n_dates is None:
        return _norm_rows(df, features, binary)
    days = df.select(date).distinct()
    n = days.agg(F.count(F.lit(1))).scalar()
    m = F.least(F.lit(n_dates), n)
    # position k is taken when some i of 0..m-1 lands on it: floor(i * (n-1) / (m-1)) = k
    k = F.row_number().over(Window.orderBy(date)) - 1
    steps = F.greatest(m - 1, F.lit(1))
    i = F.ceil(k * steps / F.greatest(n - 1, F.lit(1)))
    picked = days.withColumn("_keep", (n <= m) | (F.floor(i * (n - 1) / steps) == k)).where("_keep").select(date)
    return _norm_rows(df.join(picked, date, "left_semi"), features, binary)


def _norm_rows(sample: DataFrame, features: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """One aggregate over all features at once, turned to rows afterwards."""
    wide = sample.agg(
        *[
            F.struct(F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.count(x).alias("n")).alias(f"s{i}")
            for i, x in enumerate(F.col(f).cast("double") for f in features)
        ]
    )
    named = [F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("s")) for i, f in enumerate(features)]
    stats = wide.select(F.explode(F.array(*named)).alias("r")).select("r.feature", "r.s.*").where("n > 0").select(
        "feature", "mean", F.sqrt(F.greatest("var", F.lit(1e-8))).alias("std"), "n"
    )
    is_flag = F.col("feature").isin(list(binary)) if binary else F.lit(False)
    return stats.select(
        "feature",
        F.when(is_flag, 0.0).otherwise(F.col("mean")).alias("mean"),
        F.when(is_flag, 1.0).otherwise(F.greatest("std", F.lit(1e-6))).alias("std"),
        "n",
    )


def zscore_and_mask(df: DataFrame, stats: DataFrame, features: Sequence[str], clamp: float = 20.0) -> DataFrame:
    """Standardised features with gaps at zero and a validity flag each; ``stats`` has one row per feature."""
    # one struct with a field per feature: found by position, where a map would be searched for every value
    fields = [F.max(F.when(F.col("feature") == f, F.struct("mean", "std"))).alias(f"s{i}") for i, f in enumerate(features)]
    table = stats.agg(F.struct(*fields).alias("t")).scalar()
    cols = {}
    for i, f in enumerate(features):
        s = table[f"s{i}"]
        z = (F.col(f) - s["mean"]) / s["std"]
        cols[f"{f}_valid"] = F.col(f).isNotNull().cast("int")
        cols[f"{f}_z"] = F.coalesce(F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z)), F.lit(0.0))
    return df.withColumns(cols)


def total_variation(df: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """Mean absolute difference of neighbouring cells, along rows plus along columns, per day."""
    right = Window.partitionBy(date, "prow").orderBy("pcol")
    down = Window.partitionBy(date, "pcol").orderBy("prow")

    def step(axis: str, w) -> Column:
        touching = F.lead(axis).over(w) == F.col(axis) + 1
        return F.when(touching, F.abs(F.lead(value).over(w) - F.col(value)))

    steps = df.withColumns({"_h": step("pcol", right), "_v": step("prow", down)})
    return steps.groupBy(date).agg(
        (F.coalesce(F.avg("_h"), F.lit(0.0)) + F.coalesce(F.avg("_v"), F.lit(0.0))).alias("total_variation"),
        F.count("_h").alias("n_horizontal"),
        F.count("_v").alias("n_vertical"),
    )


def in_country_mean(df: DataFrame, inside: str, value: str = "pm25", date: str = "date") -> DataFrame:
    return df.where(F.col(inside)).groupBy(date).agg(F.avg(value).alias("mean"), F.count(value).alias("n_cells"))


def feature_grid_diagnostics(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, bins: int, height: int, width: int):
    """Mean, deviation, histogram and mean edge strength (3x3 Sobel) of a feature grid."""
    spread = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    bucket = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    histogram = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, bucket.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_bin").alias("bin"), F.col("_n").alias("n")))).alias("_hist"))
    )
    # rows and columns with their Sobel weights: (1, 2, 1) across and (-1, 0, 1) along
    offsets = F.array(
        *[
            F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"),
                     F.lit(float(dc * (2 - abs(dr)))).alias("gx"), F.lit(float(dr * (2 - abs(dc)))).alias("gy"))
            for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)
        ]
    )
    # every cell sends its weighted value to the neighbours that read it
    sent = (
        df.withColumn("_o", F.explode(offsets))
        .select(*keys, (F.col("prow") - F.col("_o.dr")).alias("prow"), (F.col("pcol") - F.col("_o.dc")).alias("pcol"),
                (F.col("_o.gx") * F.col(value)).alias("_gx"), (F.col("_o.gy") * F.col(value)).alias("_gy"))
        .where(F.col("prow").between(1, height - 2) & F.col("pcol").between(1, width - 2))
        .groupBy(*keys, "prow", "pcol")
        .agg(F.sum("_gx").alias("_gx"), F.sum("_gy").alias("_gy"), F.count("_gx").alias("_n"))
        .where("_n = 8")
    )
    edges = sent.groupBy(*keys).agg(F.avg(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)).alias("edge_strength"))
    text = F.concat_ws(",", F.transform("_hist", lambda h: F.concat_ws(":", h["bin"].cast("string"), h["n"].cast("string"))))
    return (
        spread.join(histogram, list(keys), "left").join(edges, list(keys), "left").withColumn("histogram", text).drop("_hist")
    )


def aod_coverage_audit(cells: DataFrame, date: str = "date") -> DataFrame:
    """Per day: share of in-country cells with a file and with a value, and what a shortfall means."""
    out = cells.groupBy(date).agg(
        F.avg(F.col("has_file").cast("double")).alias("file_share"),
        F.avg(F.col("value").isNotNull().cast("double")).alias("value_share"),
    )
    files, values = F.col("file_share"), F.col("value_share")
    warning = F.when((files > 0.5) & (values < 0.3), "low_retrieval").when(files < 0.3, "missing_tiles").otherwise("ok")
    return out.withColumn("warning", warning)


def export_grid_rows(df: DataFrame, width: int, value: str = "value", nodata: float = NODATA, keys: Sequence[str] = ("date",)):
    """North-up raster rows: one array of ``width`` values per (date, row), gaps filled with nodata."""
    filled = F.map_from_entries(F.collect_list(F.struct(F.col("pcol").cast("int"), F.coalesce(F.col(value), F.lit(nodata)))))
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    return (
        df.groupBy(*keys, "prow")
        .agg(filled.alias("_m"))
        .select(*keys, "prow", F.transform(columns, lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(nodata))).alias("values"))
    )


def export_predictions_json(df: DataFrame, date: str = "date", value: str = "pm25") -> DataFrame:
    """One JSON document per day: bounds, statistics and the rounded cell values in grid order.

    A day is one grid of fixed size, so its document is bounded.
    """
    stats = grid_day_stats(df, value, date)
    cells = F.array_sort(
        F.collect_list(
            F.struct(F.col("row"), F.col("col"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round(value, 2).alias("v"))
        )
    )
    grids = df.groupBy(date).agg(
        cells.alias("_c"),
        F.struct(
            F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north")
        ).alias("bounds"),
    )
    names = ["mean", "median", "min", "max", "p05", "p95", "std", "n_valid", "n_total"]
    document = F.struct(
        F.col(date).cast("string").alias("date"),
        F.struct("bounds").alias("grid"),
        F.struct(*names).alias("stats"),
        F.transform("_c", lambda c: c["lat"]).alias("lats"),
        F.transform("_c", lambda c: c["lon"]).alias("lons"),
        F.transform("_c", lambda c: c["v"]).alias("pm25"),
    )
    return grids.join(stats, date).select(date, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def representative_day(days: DataFrame, targets: dict[str, float], value: str = "mean", season: str = "season", date: str = "date"):
    """Per season the day at a percentile rank of the known daily means; a season holds one row per day."""
    days = days.where(F.col(value).isNotNull())
    w = Window.partitionBy(season)
    rank = F.row_number().over(w.orderBy(value, date)) - 1
    share = F.lit(None).cast("double")
    for name, p in targets.items():
        share = F.when(F.col(season) == name, p / 100.0).otherwise(share)
    wanted = F.bround(share * (F.count(F.lit(1)).over(w) - 1)).cast("int")
    picked = days.withColumns({"_rank": rank, "_wanted": wanted}).where(F.col("_rank") == F.col("_wanted"))
    return picked.drop("_rank", "_wanted")
