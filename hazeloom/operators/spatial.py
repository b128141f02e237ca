"""Sampling grids at points, nearest and snapped cells, polygons, priors and near pairs.

Neighbourhoods are always turned into equi-joins: index offsets, lat bands or square buckets are
exploded on the small side, and the large side is hashed on the same integers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GRID_COLS, GRID_LAT_MAX, GRID_LON_MIN, GRID_RES, GRID_ROWS, KM_PER_DEG_SPLAT
from ..functions.geo import haversine_km
from ..functions.ids import cell_id
from .cells import places_in_cover, polygon_cover
from .nearby import bucket_x, buckets_around, near_differences
from .nearest import nearest_cells


@dataclass(frozen=True)
class Axis:
    """Regular axis: value of index i is ``origin + step * i``."""

    origin: float
    step: float
    size: int

    def position(self, value: Column) -> Column:
        return (value - self.origin) / self.step

    def value(self, index: Column) -> Column:
        return F.lit(self.origin) + F.lit(self.step) * index

    def nearest(self, value: Column) -> Column:
        index = F.bround(self.position(value)).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.size - 1), index))


GRID_LAT = Axis(GRID_LAT_MAX, -GRID_RES, GRID_ROWS)
GRID_LON = Axis(GRID_LON_MIN, GRID_RES, GRID_COLS)


def static_grid(spark, lat: Axis = GRID_LAT, lon: Axis = GRID_LON) -> DataFrame:
    """Cells north to south, west to east; one row per cell."""
    index = F.col("id")
    row = F.floor(index / lon.size).cast("int")
    col = (index % lon.size).cast("int")
    return (
        spark.range(lat.size * lon.size)
        .select(row.alias("row"), col.alias("col"))
        .withColumns({"lat": F.round(lat.value(F.col("row")), 6), "lon": F.round(lon.value(F.col("col")), 6)})
        .withColumn("cell_id", cell_id(F.col("lat"), F.col("lon")))
    )


def nearest_grid_cell(points: DataFrame, lat_axis: Axis, lon_axis: Axis, lat: str = "lat", lon: str = "lon") -> DataFrame:
    out = points.withColumns({"iy": lat_axis.nearest(F.col(lat)), "ix": lon_axis.nearest(F.col(lon))})
    out = out.withColumns({"grid_lat": lat_axis.value(F.col("iy")), "grid_lon": lon_axis.value(F.col("ix"))})
    distance = haversine_km(F.col(lat), F.col(lon), F.col("grid_lat"), F.col("grid_lon"))
    return out.withColumn("grid_dist_km", distance)


def nearest_axis_value(df: DataFrame, axis: DataFrame, axis_col: str, value: str, out: str) -> DataFrame:
    """Nearest value of an irregular axis; an axis is one grid dimension, a few hundred numbers."""
    values = axis.agg(F.sort_array(F.collect_set(axis_col))).scalar()
    pairs = F.transform("_axis", lambda a: F.struct(F.abs(a - F.col(value)).alias("d"), a.alias("a")))
    return df.withColumn("_axis", values).withColumn(out, F.array_min(pairs)["a"]).drop("_axis")


def valid_cell_mask(cube: DataFrame, time: str, variables: Sequence[str]) -> DataFrame:
    """Cells whose reference variables are all present at the first time step."""
    first = cube.agg(F.min(time)).scalar()
    known = F.lit(True)
    for v in variables:
        known = known & F.col(v).isNotNull()
    return cube.where(F.col(time) == first).where(known)


def snap_to_valid(points: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Nearest valid cell of every point, in latitude and longitude scaled by the median latitude of the cells.

    ``cells`` has columns ``cell_lat`` and ``cell_lon``. Points that share a place are searched once
    (``nearest.nearest_cells``); a point without coordinates gets no cell.
    """
    found = nearest_cells(points.select(F.col(lat).alias("_y"), F.col(lon).alias("_x")), cells)
    out = points.join(found, (F.col(lat) == F.col("_y")) & (F.col(lon) == F.col("_x")), "left").drop("_y", "_x")
    distance = haversine_km(F.col(lat), F.col(lon), F.col("cell_lat"), F.col("cell_lon"))
    return out.withColumn("snap_dist_km", distance)


def _corners(positions: Sequence[tuple[str, Column, Axis]]) -> Column:
    """Array of structs (one index per axis, weight) of the surrounding grid nodes with weight > 0."""
    names = [n for n, _, _ in positions]
    corners = [([], F.lit(1.0))]
    for _, p, _ in positions:
        low = F.floor(p).cast("int")
        fraction = p - low
        corners = [
            ([*index, low + step], weight * (fraction if step else 1.0 - fraction))
            for index, weight in corners
            for step in (0, 1)
        ]
    structs = [
        F.struct(*[i.alias(n) for i, n in zip(index, names)], weight.alias("w")) for index, weight in corners
    ]
    inside = F.lit(True)
    for _, p, axis in positions:
        inside = inside & (p >= 0) & (p <= axis.size - 1)
    return F.when(inside, F.filter(F.array(*structs), lambda c: c["w"] > 0))


def sample_linear(
    targets: DataFrame,
    cube: DataFrame,
    keys: Sequence[str],
    axes: Sequence[tuple[str, Column, Axis]],
    value: str = "value",
    equal: Sequence[str] = (),
) -> DataFrame:
    """Multi-linear interpolation of a cube at target positions; NULL if any used node is missing.

    ``axes`` lists (index column of the cube, value on the target side, axis); ``equal`` are plain
    join columns such as the date when time is not interpolated.
    """
    positions = [(n, axis.position(v), axis) for n, v, axis in axes]
    names = [n for n, _, _ in axes]
    exploded = (
        targets.select(*dict.fromkeys([*keys, *equal]), _corners(positions).alias("_all"))
        .withColumn("_need", F.size("_all"))
        .withColumn("_c", F.explode_outer("_all"))
        .select(*dict.fromkeys([*keys, *equal]), "_need", "_c.*")
    )
    joined = exploded.join(cube.select(*equal, *names, F.col(value).alias("_v")), [*equal, *names], "left")
    return joined.groupBy(*keys).agg(
        F.when(F.count("_v") == F.first("_need"), F.sum(F.col("w") * F.col("_v"))).alias(value)
    )


def sample_nearest(targets: DataFrame, cube: DataFrame, axes: Sequence[tuple[str, Column, Axis]], equal: Sequence[str], value="value"):
    """Value of the nearest node per axis."""
    indexed = targets.withColumns({n: axis.nearest(v) for n, v, axis in axes})
    return indexed.join(cube.select(*equal, *[n for n, _, _ in axes], value), [*equal, *[n for n, _, _ in axes]], "left")


def regrid_linear(cube: DataFrame, source: tuple[Axis, Axis], target: tuple[Axis, Axis], time: str = "date", value="value"):
    """Bilinear regridding of every time step: node weights per target cell are a small static table."""
    cells = static_grid(cube.sparkSession, *target)
    positions = [("iy", source[0].position(F.col("lat")), source[0]), ("ix", source[1].position(F.col("lon")), source[1])]
    weights = (
        cells.withColumn("_all", _corners(positions))
        .where(F.col("_all").isNotNull())
        .withColumn("_need", F.size("_all"))
        .withColumn("_c", F.explode("_all"))
        .select("row", "col", "_need", "_c.*")
    )
    joined = cube.select(time, "iy", "ix", value).join(weights, ["iy", "ix"])
    full = F.when(F.count(value) == F.first("_need"), F.sum(F.col("w") * F.col(value)))
    return joined.groupBy(time, "row", "col").agg(full.alias(value))


def nearest_raster_sample(points: DataFrame, raster: DataFrame, lat: Axis, lon: Axis, equal: Sequence[str] = ("date",)):
    """Raster value under each point: indices are cut, not rounded, and outside gives NULL."""
    row_pos, col_pos = lat.position(F.col("lat")), lon.position(F.col("lon"))
    inside = (row_pos >= 0) & (row_pos < lat.size) & (col_pos >= 0) & (col_pos < lon.size)
    indexed = points.withColumns(
        {"iy": F.when(inside, row_pos.cast("int")), "ix": F.when(inside, col_pos.cast("int"))}
    )
    return indexed.join(raster, [*equal, "iy", "ix"], "left")


def bilinear_raster_sample(
    points: DataFrame, raster: DataFrame, lat: Axis, lon: Axis, keys: Sequence[str], equal: Sequence[str] = ("date",), value="value"
):
    """Four-node blend inside, the node under the point along the last row and column."""
    row_pos, col_pos = lat.position(F.col("lat")), lon.position(F.col("lon"))
    r0, c0 = row_pos.cast("int"), col_pos.cast("int")
    t, u = row_pos - r0, col_pos - c0
    blend = (row_pos >= 0) & (r0 < lat.size - 1) & (col_pos >= 0) & (c0 < lon.size - 1)
    inside = (row_pos >= 0) & (row_pos < lat.size) & (col_pos >= 0) & (col_pos < lon.size)

    def node(dr: int, dc: int, w: Column) -> Column:
        return F.struct((r0 + dr).alias("iy"), (c0 + dc).alias("ix"), w.alias("w"))

    four = F.array(
        node(0, 0, (1 - t) * (1 - u)), node(0, 1, (1 - t) * u), node(1, 0, t * (1 - u)), node(1, 1, t * u)
    )
    nodes = F.when(blend, four).when(inside, F.array(node(0, 0, F.lit(1.0).cast("double"))))
    exploded = (
        points.select(*keys, *[c for c in equal if c not in keys], nodes.alias("_all"))
        .withColumn("_need", F.size("_all"))
        .withColumn("_n", F.explode_outer("_all"))
        .select(*keys, *[c for c in equal if c not in keys], "_need", "_n.*")
    )
    joined = exploded.join(raster.select(*equal, "iy", "ix", F.col(value).alias("_v")), [*equal, "iy", "ix"], "left")
    return joined.groupBy(*keys).agg(
        F.when(F.count("_v") == F.first("_need"), F.sum(F.col("w") * F.col("_v"))).alias(value)
    )


def point_in_polygon(points: DataFrame, edges: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows (key, poly_id, name) for every polygon that contains the point.

    Distinct places meet the cell cover of the polygons (``cells``); points then take the answer of their place.
    A point without a latitude or longitude is in no polygon.
    """
    places = points.select(F.col(lat).alias("_y"), F.col(lon).alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    found = places_in_cover(places.distinct(), polygon_cover(edges))
    at = points.select(key, F.col(lat).alias("_y"), F.col(lon).alias("_x"))
    return at.join(found, ["_y", "_x"]).select(key, "poly_id", "name")


def _with_place(points: DataFrame, edges: DataFrame, lat: str, lon: str, found: Column) -> DataFrame:
    """``points`` with ``_p``, an aggregate over the polygons of each point's place."""
    places = points.select(F.col(lat).alias("_y"), F.col(lon).alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    inside = places_in_cover(places.distinct(), polygon_cover(edges)).groupBy("_y", "_x").agg(found.alias("_p"))
    return points.join(inside, (F.col(lat) == F.col("_y")) & (F.col(lon) == F.col("_x")), "left").drop("_y", "_x")


def province_join(
    points: DataFrame, edges: DataFrame, out: str = "province", default: str = "Unknown", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Polygon name per point (lowest polygon number wins on overlaps), else the default."""
    placed = _with_place(points, edges, lat, lon, F.min_by("name", "poly_id"))
    return placed.withColumn(out, F.coalesce("_p", F.lit(default))).drop("_p")


def country_mask(cells: DataFrame, edges: DataFrame, out: str = "inside", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Whether each point lies in any of the polygons."""
    placed = _with_place(cells, edges, lat, lon, F.count(F.lit(1)))
    return placed.withColumn(out, F.col("_p").isNotNull()).drop("_p")


def lag1_prior(
    observations: DataFrame,
    lat_axis: Axis = GRID_LAT,
    lon_axis: Axis = GRID_LON,
    sigma_km: float = 60.0,
    radius_km: float = 180.0,
    eps: float = 1e-6,
) -> DataFrame:
    """Yesterday's stations spread over the cells of the following day with Gaussian weights.

    Observations (date, lat, lon, pm25) sharing a place are summed first, since they share all weights.
    Returns (date, row, col, prior, coverage) for covered cells; ``coverage`` is log1p of the weights.
    """
    step = abs(lat_axis.step)
    rows_each_way = int(-(-radius_km // (KM_PER_DEG_SPLAT * step)))
    merged = (
        observations.where(F.col("pm25").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("date", "lat", "lon")
        .agg(F.sum("pm25").alias("_sum"), F.count("pm25").alias("_n"))
    )
    cos_lat = F.greatest(F.cos(F.radians("lat")), F.lit(0.2))
    centred = merged.select(
        F.date_add("date", 1).alias("date"),
        "_sum",
        "_n",
        cos_lat.alias("_cos"),
        F.bround(lat_axis.position(F.col("lat"))).cast("int").alias("_r"),
        F.bround(lon_axis.position(F.col("lon"))).cast("int").alias("_c"),
    ).withColumn("_reach", F.ceil(radius_km / (KM_PER_DEG_SPLAT * step * F.col("_cos"))).cast("int"))
    spread = (
        centred.withColumn("_dr", F.explode(F.sequence(F.lit(-rows_each_way), F.lit(rows_each_way))))
        .withColumn("row", F.col("_r") + F.col("_dr"))
        .where(F.col("row").between(0, lat_axis.size - 1))
        .withColumn("_dc", F.explode(F.sequence(-F.col("_reach"), F.col("_reach"))))
        .withColumn("col", F.col("_c") + F.col("_dc"))
        .where(F.col("col").between(0, lon_axis.size - 1))
    )
    dy = F.col("_dr") * (KM_PER_DEG_SPLAT * step)
    dx = F.col("_dc") * (KM_PER_DEG_SPLAT * step) * F.col("_cos")
    distance = F.sqrt(dy * dy + dx * dx)
    weighted = spread.withColumn("_d", distance).where(F.col("_d") <= radius_km)
    w = F.exp(-0.5 * F.pow(F.col("_d") / sigma_km, 2))
    sums = weighted.groupBy("date", "row", "col").agg(
        F.sum(w * F.col("_n")).alias("_w"), F.sum(w * F.col("_sum")).alias("_wy")
    )
    return sums.select(
        "date",
        "row",
        "col",
        F.when(F.col("_w") > eps, F.col("_wy") / F.col("_w")).alias("prior"),
        F.log1p("_w").alias("coverage"),
    )


def near_pairs(sites: DataFrame, key: str, max_km: float) -> DataFrame:
    """Unordered pairs of sites within a distance, as (a, b, km).

    Sites meet only through square buckets one search radius wide, each unordered pair once; the join
    is an equi-join that adaptive execution splits where one bucket is crowded.
    """
    width = max_km / 100.0
    site = sites.select(key, "lat", "lon").withColumn("_by", F.floor(F.col("lat") / width))
    right = site.select(
        F.col(key).alias("b"), F.col("lat").alias("_blat"), F.col("lon").alias("_blon"), "_by",
        bucket_x(F.col("_by"), F.col("lon"), width).alias("_bx"),
    )
    ring = F.sequence(F.lit(-1), F.lit(1))
    beside = F.array_distinct(
        F.transform(ring, lambda d: F.pmod(bucket_x(F.col("_by"), F.col("_alon"), width) + d, buckets_around(F.col("_by"), width)))
    )
    left = (
        site.select(F.col(key).alias("a"), F.col("lat").alias("_alat"), F.col("lon").alias("_alon"), "_by")
        .withColumn("_by", F.explode(F.transform(ring, lambda d: F.col("_by") + d)))
        .withColumn("_bx", F.explode(beside))
    )
    km = haversine_km(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon"))
    return (
        left.join(right, ["_by", "_bx"])
        .where(F.col("a") < F.col("b"))
        .select("a", "b", km.alias("km"))
        .where(F.col("km") <= max_km)
    )


def pairwise_disagreement(
    daily: DataFrame, sites: DataFrame, season: Column, bands: Sequence[float] = (0.0, 1.0, 2.0, 5.0, 10.0), key="sensor_id"
) -> DataFrame:
    """Mean absolute same-day difference of station pairs by distance band and season.

    Neither pairs of stations nor their days are formed (``nearby.near_differences``); (key, date) is unique in
    ``daily``, and ``season`` depends on the date alone.
    """
    at = daily.select(key, "date", F.col("pm25").alias("value")).join(sites.select(key, "lat", "lon"), key)
    found = near_differences(at, bands)
    names = F.array(*[F.lit(f"{low:g}-{high:g}") for low, high in zip(bands, bands[1:])])
    return found.groupBy(F.get(names, F.col("band")).alias("band"), season.alias("season")).agg(
        F.sum("n_pairs").alias("n_pairs"), F.try_divide(F.sum("total"), F.sum("n_known")).alias("mae")
    )
