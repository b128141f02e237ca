"""Splits and folds as labels computed from keys; random choices are hashes, so any cluster agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import latlon_to_km
from ..semantics import flag
from ..session import stored
from .keyed_kmeans import keyed_kmeans


def hash_bucket(key: Column, k: int, seed: int) -> Column:
    """Bucket in 0..k-1 from the leading hex digits of an MD5, the same in every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % k).cast("int")


def year_split(df: DataFrame, train: Sequence[int], dev: Sequence[int], test: Sequence[int], date: str = "date") -> DataFrame:
    y = F.year(date)
    label = F.when(y.isin(list(train)), "train").when(y.isin(list(dev)), "dev").when(y.isin(list(test)), "test")
    return df.withColumn("split", label)


def rolling_year_folds(df: DataFrame, val_years: Sequence[int], date: str = "date") -> DataFrame:
    """Each row once per fold that uses it: validation in its own year, training in every later fold."""
    later = F.filter(F.array(*[F.lit(y) for y in val_years]), lambda v: v >= F.year(date))
    out = df.withColumn("fold", F.explode(later))
    return out.withColumn("role", F.when(F.year(date) == F.col("fold"), "val").otherwise("train"))


def waterline_label(date: Column, reference: Column, cutoff_days: int = 90, validation_days: int = 90) -> Column:
    """'train' before the validation window, 'val' inside it, NULL after the waterline."""
    waterline = F.date_sub(reference, cutoff_days)
    start = F.date_sub(waterline, validation_days)
    return F.when(date < start, "train").when(date <= waterline, "val")


def _required(condition: Column, message: str) -> Column:
    """True, or an error when the rows are read."""
    return F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def waterline_split(df: DataFrame, reference: str, cutoff_days: int = 90, validation_days: int = 90, min_train_years: int = 2, date="date"):
    """Rows before the waterline with their role; reading them fails if training spans too few years."""
    labelled = df.withColumn("split", waterline_label(F.col(date), F.lit(reference).cast("date"), cutoff_days, validation_days))
    years = labelled.where("split = 'train'").agg(F.countDistinct(F.year(date))).scalar()
    enough = _required(years >= min_train_years, f"training spans fewer than {min_train_years} years")
    return labelled.where(F.col("split").isNotNull() & enough)


def monthly_waterlines(
    df: DataFrame, start: str, end: str, cutoff_days: int = 90, validation_days: int = 90, date: str = "date"
) -> DataFrame:
    """Train and validation sizes of the waterline split at every month start of a range.

    Counts per day come first (one row per calendar day), so the months multiply days, not rows.
    """
    per_day = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 MONTH"))
    role = waterline_label(F.col(date), F.col("reference_date"), cutoff_days, validation_days)
    return (
        per_day.withColumn("reference_date", F.explode(months))
        .withColumn("_role", role)
        .groupBy("reference_date")
        .agg(
            F.sum(F.when(F.col("_role") == "train", F.col("_n")).otherwise(0)).alias("n_train"),
            F.sum(F.when(F.col("_role") == "val", F.col("_n")).otherwise(0)).alias("n_val"),
            F.countDistinct(F.when(F.col("_role") == "train", F.year(date))).alias("train_years"),
        )
    )


def station_kfold(df: DataFrame, k: int, seed: int = 42, key: str = "sensor_id") -> DataFrame:
    return df.withColumn("fold", hash_bucket(F.col(key), k, seed))


def sensor_kfold_in_province(df: DataFrame, province: str, k: int, seed: int = 42, key: str = "sensor_id") -> DataFrame:
    """Fold of each station of one province (NULL elsewhere: always training); an error if it has fewer than k."""
    inside = F.col("province") == province
    stations = df.where(inside).agg(F.countDistinct(key)).scalar()
    fold = F.when(inside, hash_bucket(F.col(key), k, seed))
    return df.where(_required(stations >= max(2, k), f"{province} has fewer than {max(2, k)} stations")).withColumn("fold", fold)


def time_block(df: DataFrame, province: str, test_days: int = 180, date: str = "date") -> DataFrame:
    """Last days of one province held out; training is everything up to the cutoff, everywhere."""
    inside = F.col("province") == province
    last = df.where(inside).agg(F.max(date)).scalar()
    cutoff = F.date_sub(last, test_days)
    role = F.when(F.col(date) <= cutoff, "train").when(inside, "test")
    return df.withColumn("split", role).where("split IS NOT NULL")


def grid_block_id(x: Column, y: Column, size: Column | float) -> Column:
    bx, by = F.floor(x / size).cast("long"), F.floor(y / size).cast("long")
    return F.concat_ws("_", bx.cast("string"), by.cast("string"))


def grid_blocks(
    sites: DataFrame, key: str = "sensor_id", by: str = "province", grid_km: float = 75.0, shrink: float = 0.7, least_km: float = 5.0,
    kmeans: int = 12,
) -> DataFrame:
    """Square blocks per province at the largest size of the shrinking sequence that gives two or more.

    Provinces whose sites lie too close for that get up to ``kmeans`` clusters instead, ``grid_km`` NULL, all of them
    in the same jobs; one with a single place is one block.
    """
    sizes, g = [], grid_km
    while g >= least_km:
        sizes.append(g)
        g *= shrink
    reference = sites.groupBy(by).agg(F.avg("lat").alias("_ref"))
    placed = sites.join(reference, by)
    x, y = latlon_to_km(F.col("lat"), F.col("lon"), F.col("_ref"))
    sized = placed.withColumn("grid_km", F.explode(F.array(*[F.lit(float(s)) for s in sizes]))).withColumn(
        "block_id", grid_block_id(x, y, F.col("grid_km"))
    )
    chosen = (
        sized.groupBy(by, "grid_km")
        .agg(F.countDistinct("block_id").alias("n_blocks"))
        .where("n_blocks >= 2")
        .groupBy(by)
        .agg(F.max(F.struct("grid_km", "n_blocks")).alias("_c"))
        .select(by, "_c.*")
    )
    squares = sized.join(chosen, [by, "grid_km"]).select(key, by, "grid_km", "n_blocks", "block_id")
    rest = sites.join(chosen.select(F.col(by).alias("_by")), F.col(by).eqNullSafe(F.col("_by")), "left_anti")
    rest = stored(rest.select(key, by, "lat", "lon"), "unsquared")
    if rest.isEmpty():
        return squares
    none = F.lit(None).cast("double").alias("grid_km")
    return squares.unionByName(_clustered(rest, by, kmeans).select(key, by, none, "n_blocks", "block_id"))


def _clustered(sites: DataFrame, by: str, k: int) -> DataFrame:
    """Sites with ``block_id`` and ``n_blocks`` from k-means in km inside every group of ``by``, all groups together."""
    middle = sites.groupBy(F.col(by).alias("_by")).agg(F.avg("lat").alias("_ref"))
    x, y = latlon_to_km(F.col("lat"), F.col("lon"), F.col("_ref"))
    placed = sites.join(middle, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumns({"_x": x, "_y": y})
    placed = stored(placed, "placed")  # the same numbers for both sides of the join below
    found = keyed_kmeans(placed, by, k, "_x", "_y").withColumnsRenamed({by: "_by", "_x": "_cx", "_y": "_cy"})
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy"))
    block = F.concat(F.lit("c"), F.col("cluster").cast("string"))
    return placed.join(found, same).select(*sites.columns, block.alias("block_id"), F.col("n_clusters").alias("n_blocks"))


def kmeans_blocks(sites: DataFrame, n_blocks: int = 12, key: str = "sensor_id") -> DataFrame:
    """Blocks of sites by distance in km, for regions a square grid cannot divide."""
    one = sites.select(key, "lat", "lon", F.lit("all").alias("_of"))
    return _clustered(one, "_of", n_blocks).select(key, "block_id")


def spatial_block_folds(sites: DataFrame, k: int, seed: int = 42, key: str = "sensor_id", by: str = "province") -> DataFrame:
    """Fold per site: blocks of a province are put in hash order and cut into at most k even runs.

    The windows run over distinct blocks, not over sites.  A province that is one block has no fold: it trains always.
    """
    blocks = grid_blocks(sites, key, by)
    unique = blocks.select(by, "block_id").distinct()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), by, "block_id"))
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    folds = unique.withColumn("k_eff", F.least(F.lit(k), n)).withColumn(
        "fold", ((F.row_number().over(w.orderBy(order)) - 1) % F.col("k_eff")).cast("int")
    )
    folds = folds.withColumn("fold", F.when(F.col("k_eff") > 1, F.col("fold")))
    folds = folds.withColumnsRenamed({by: "_by", "block_id": "_block"})
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("block_id") == F.col("_block"))
    return blocks.join(folds, same).drop("_by", "_block")


def degree_blocks(df: DataFrame, cell_degrees: float = 0.5, by: str = "province", lat: str = "lat", lon: str = "lon") -> DataFrame:
    lat_bin = F.floor(F.col(lat) / cell_degrees).cast("string")
    lon_bin = F.floor(F.col(lon) / cell_degrees).cast("string")
    return df.withColumn("spatial_block", F.concat_ws("_", F.col(by), lat_bin, lon_bin))


def stratified_block_split(
    rows: DataFrame,
    by: str = "province",
    block: str = "spatial_block",
    val_frac: float = 0.20,
    min_val_frac: float = 0.18,
    min_val_rows: int = 0,
    max_val_frac: float = 0.35,
    seed: int = 42,
) -> DataFrame:
    """Validation blocks: per province in hash order up to the share, then the largest others as top-up.

    The top-up goes on to the smaller share of all rows and, if given, to ``min_val_rows``.

    Returns one row per block with ``n`` and ``is_val``.  The running sums are over blocks.
    """
    sizes = rows.groupBy(by, block).agg(F.count(F.lit(1)).alias("n"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), by, block))
    w = Window.partitionBy(by)
    before = F.sum("n").over(w.orderBy(order, block)) - F.col("n")
    target = F.ceil(F.sum("n").over(w) * val_frac)
    picked = sizes.withColumns({"_before": before, "_target": target}).withColumn(
        "_first", flag(F.col("_before") < F.col("_target"))
    )
    everything = Window.partitionBy()
    totals = picked.withColumns(
        {
            "_total": F.sum("n").over(everything),
            "_val": F.sum(F.when(F.col("_first") == 1, F.col("n")).otherwise(0)).over(everything),
        }
    )
    need = F.greatest(F.ceil(F.col("_total") * min_val_frac), F.lit(min_val_rows))
    limit = F.floor(F.col("_total") * max_val_frac)
    spare = F.when(F.col("_first") == 0, F.col("n")).otherwise(0)
    reached = F.col("_val") + F.sum(spare).over(Window.orderBy(F.col("_first"), F.desc("n"), by, block)) - spare
    topped = totals.withColumns({"_need": need, "_limit": limit, "_reached": reached})
    extra = (F.col("_first") == 0) & (F.col("_reached") < F.col("_need")) & (F.col("_reached") < F.col("_limit"))
    return topped.withColumn("is_val", flag((F.col("_first") == 1) | extra)).select(by, block, "n", "is_val")


def leave_one_province_out(df: DataFrame, by: str = "province", key: str = "sensor_id", min_stations: int = 2, min_rows: int = 30):
    """Sizes of the train and test parts for every province that is large enough to be held out."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct(key).alias("n_stations"))
    total = df.agg(F.count(F.lit(1))).scalar()
    keep = (F.col("n_stations") >= min_stations) & (F.col("n_test") >= min_rows) & (F.col(by) != "Unknown")
    return per.where(keep).withColumn("n_train", total - F.col("n_test"))


def lopo_label(df: DataFrame, held_out: str, by: str = "province") -> DataFrame:
    return df.withColumn("split", F.when(F.col(by) == held_out, "test").otherwise("train"))


def nested_month_station_folds(df: DataFrame, k: int, seed: int = 42, key: str = "sensor_id", date: str = "date") -> DataFrame:
    """Rows and stations per role in every (test month, station fold): earlier months of other stations
    train, the test month of other stations anchors, the test month of the held-out stations tests.

    Only counts per month and station bucket are expanded over months and folds.  A station trains from
    the month after its first one, so distinct stations follow from first months.
    """
    month = F.date_format(date, "yyyy-MM")
    per = df.groupBy(month.alias("month"), key).agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("_own", hash_bucket(F.col(key), k, seed))
    sizes = per.groupBy("month", "_own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_stations"))
    first = per.groupBy(key, "_own").agg(F.min("month").alias("month")).groupBy("month", "_own").agg(
        F.count(F.lit(1)).alias("_new")
    )
    months = sizes.agg(F.sort_array(F.collect_set("month"))).scalar()
    table = sizes.join(first, ["month", "_own"], "left").na.fill(0, ["_new"]).withColumn("_months", months)
    later = F.filter("_months", lambda m: (m > F.get(F.col("_months"), 0)) & (m >= F.col("month")))
    spread = table.withColumn("test_month", F.explode(later)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held, same = F.col("_own") == F.col("fold"), F.col("month") == F.col("test_month")
    role = F.when(held & same, "test").when(~held & same, "anchor").when(~held, "train")
    stations = F.when(F.col("role") == "train", F.col("_new")).otherwise(F.col("n_stations"))
    return spread.withColumn("role", role).where("role IS NOT NULL").groupBy("test_month", "fold", "role").agg(
        F.sum("n").alias("n"), F.sum(stations).alias("n_stations")
    )


def random_holdout(df: DataFrame, key: Column, percent: int = 20, seed: int = 42) -> DataFrame:
    """Share of rows or stations, depending on the key, held out for early stopping."""
    return df.withColumn("is_val", hash_bucket(key, 100, seed) < percent)


def history_dropout(df: DataFrame, columns: Sequence[str], key: Column, percent: int = 20, seed: int = 42) -> DataFrame:
    """Withholds the whole history block of a share of the rows."""
    dropped = hash_bucket(key, 100, seed) < percent
    return df.withColumns({c: F.when(~dropped, F.col(c)) for c in columns} | {"history_dropped": dropped.cast("int")})


def holdout_split(df: DataFrame, held: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows by key."""
    ids = held.select(*keys)
    return df.join(ids, list(keys), "left_anti"), df.join(ids, list(keys), "left_semi")
