"""Keys: stable station ids, slugs, grid-cell ids and site keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sensor_id(lat: Column, lon: Column) -> Column:
    """Unsigned 32-bit id from the SHA-1 of the coordinates at five decimals."""
    text = F.format_string("%.5f,%.5f", lat.cast("double"), lon.cast("double"))
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def sensor_slug(*parts: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
    """Lower-case name with single underscores; falls back to the coordinates, then 'unknown'."""
    present = [F.when(F.trim(p.cast("string")) != "", p.cast("string")) for p in parts]
    joined = F.lower(F.concat_ws("_", *present))
    squeezed = F.regexp_replace(F.regexp_replace(joined, r"[^\w]+", "_"), "__+", "_")
    slug = F.nullif(F.regexp_replace(squeezed, "^_+|_+$", ""), F.lit(""))
    choices = [slug]
    if lat is not None and lon is not None:
        choices.append(F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("pt_%.4f_%.4f", lat, lon)))
    return F.coalesce(*choices, F.lit("unknown"))


def cell_id(lat: Column, lon: Column) -> Column:
    return F.format_string("%.2f_%.2f", lat.cast("double"), lon.cast("double"))


def site_key(lat: Column, lon: Column, decimals: int = 3) -> Column:
    return F.concat_ws("_", F.round(lat, decimals).cast("string"), F.round(lon, decimals).cast("string"))


def anonymous_station_key(station: Column, salt: str, prefix: str = "PK") -> Column:
    """Publishable station key: prefix and ten hex digits of a salted SHA-1."""
    digest = F.sha1(F.concat(F.lit(salt), station.cast("string")))
    return F.concat(F.lit(prefix), F.substring(digest, 1, 10))
