"""Distances, projections and pixel addressing as closed-form columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    EARTH_RADIUS_KM,
    GRID_COLS,
    GRID_LAT_MAX,
    GRID_LON_MIN,
    GRID_RES,
    GRID_ROWS,
    KM_PER_DEG_LAT_BLOCK,
    KM_PER_DEG_LAT_PIXEL,
    KM_PER_DEG_LON,
    SINUSOIDAL_H_MAX,
    SINUSOIDAL_RADIUS_M,
    SINUSOIDAL_TILE_M,
    SINUSOIDAL_TILE_PIXELS,
    SINUSOIDAL_V_MAX,
    SINUSOIDAL_X_MIN,
    SINUSOIDAL_Y_MAX,
)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def latlon_to_km(lat: Column, lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    """Local equirectangular x, y in km around one reference latitude."""
    return lon * KM_PER_DEG_LON * F.cos(F.radians(ref_lat)), lat * KM_PER_DEG_LAT_BLOCK


def pixels_per_km(lat: Column, res_x: Column, res_y: Column, projected: bool = False) -> Column:
    """Mean pixel density along both axes; a projected raster gives its resolution in metres."""
    if projected:
        mean_res = (F.abs(res_x) + F.abs(res_y)) / 2.0
        return F.when(mean_res > 0, 1000.0 / mean_res).otherwise(1.0)
    km_x = F.abs(res_x) * KM_PER_DEG_LON * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    km_y = F.abs(res_y) * KM_PER_DEG_LAT_PIXEL
    per_x = F.when(km_x > 0, 1.0 / km_x).otherwise(1.0)
    per_y = F.when(km_y > 0, 1.0 / km_y).otherwise(1.0)
    return (per_x + per_y) / 2.0


def normalize_longitude(lon: Column, grid_lon_max: Column, lon_min: Column) -> Column:
    """Shift to 0..360 where the grid uses that convention and the points do not."""
    return F.when((grid_lon_max > 180) & (lon_min < 0), F.pmod(lon + 360.0, F.lit(360.0))).otherwise(lon)


def in_bbox(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def sinusoidal_tile_pixel(lat: Column, lon: Column) -> Column:
    """Struct (h, v, row, col) of the sinusoidal tile grid; NULL where the mapping leaves the grid."""
    phi = F.radians(lat)
    east = SINUSOIDAL_RADIUS_M * F.radians(lon) * F.cos(phi) - SINUSOIDAL_X_MIN
    south = SINUSOIDAL_Y_MAX - SINUSOIDAL_RADIUS_M * phi
    pixel = SINUSOIDAL_TILE_M / SINUSOIDAL_TILE_PIXELS
    h = (east / SINUSOIDAL_TILE_M).cast("int")
    v = (south / SINUSOIDAL_TILE_M).cast("int")
    row = ((south - v * SINUSOIDAL_TILE_M) / pixel).cast("int")
    col = ((east - h * SINUSOIDAL_TILE_M) / pixel).cast("int")
    last = SINUSOIDAL_TILE_PIXELS - 1
    inside = (
        h.between(0, SINUSOIDAL_H_MAX) & v.between(0, SINUSOIDAL_V_MAX) & row.between(0, last) & col.between(0, last)
    )
    return F.when(inside, F.struct(h.alias("h"), v.alias("v"), row.alias("row"), col.alias("col")))


def station_unit_coords(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) of a point on the prediction grid scaled to [-1, 1] and clipped."""

    def unit(position: Column, n: int) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * position / (n - 1) - 1.0))

    y = unit((GRID_LAT_MAX - lat) / GRID_RES, GRID_ROWS)
    x = unit((lon - GRID_LON_MIN) / GRID_RES, GRID_COLS)
    return x, y
