"""Pixel masks, quality bits, missing flags and prediction clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AOD_VALID_RANGE, QA_THRESHOLD, RASTER_SANITY_LIMIT


def in_range_or_null(v: Column, low: float, high: float) -> Column:
    return F.when((v >= low) & (v <= high), v)


def physical_range_mask(df: DataFrame, aod: str, raster: str, lat: str, lon: str) -> DataFrame:
    """NULL out impossible values and say why a row's location is unusable."""
    reason = (
        F.when(F.col(lat).isNull() | F.col(lon).isNull(), "missing_coordinates")
        .when(~F.col(lat).between(-90, 90) | ~F.col(lon).between(-180, 180), "coordinates_out_of_range")
        .otherwise("")
    )
    return df.withColumns(
        {
            aod: in_range_or_null(F.col(aod), *AOD_VALID_RANGE),
            raster: in_range_or_null(F.col(raster), -RASTER_SANITY_LIMIT, RASTER_SANITY_LIMIT),
            "invalid_reason": reason,
        }
    )


def scale_offset_fill(raw: Column, scale: Column, offset: Column, fill: Column) -> Column:
    """Physical value; the fill test looks at the raw number."""
    return F.when(~raw.eqNullSafe(fill), raw * scale + offset)


def qa_pass(qa: Column, threshold: float = QA_THRESHOLD) -> Column:
    """A missing quality value fails."""
    return F.coalesce(qa >= threshold, F.lit(False))


def qa_filter(value: Column, qa: Column, threshold: float = QA_THRESHOLD) -> Column:
    return F.when(qa_pass(qa, threshold), value)


def qa_bits(qa: Column) -> dict[str, Column]:
    """Cloud mask (bits 0-2), adjacency (bits 5-7) and retrieval quality (bits 8-11)."""
    q = qa.cast("int")
    return {
        "qa_cloudmask": q.bitwiseAND(F.lit(7)),
        "qa_adjacency": F.shiftright(q, 5).bitwiseAND(F.lit(7)),
        "qa_aod": F.shiftright(q, 8).bitwiseAND(F.lit(15)),
    }


def mode_in_range(v: Column, max_value: int) -> Column:
    """Most frequent integer in [0, max]; ties go to the smallest."""
    return F.mode(F.when(v.between(0, max_value), v), deterministic=True)


def missing_flags(df: DataFrame, columns: Sequence[str], products: dict[str, Sequence[str]]) -> DataFrame:
    cols = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns if c in df.columns}
    for product, sources in products.items():
        have = [F.col(c) for c in sources if c in df.columns]
        if have:
            any_value = have[0].isNotNull()
            for c in have[1:]:
                any_value = any_value | c.isNotNull()
            cols[f"{product}_available"] = any_value.cast("int")
    return df.withColumns(cols)


def clip_and_mask(prediction: Column, inside: Column) -> Column:
    """Outside the country NULL, below zero 0."""
    return F.when(inside, F.greatest(prediction, F.lit(0.0)))


def first_available_band(df: DataFrame, candidates: Sequence[str], qa_candidates: Sequence[str], fallback: str) -> DataFrame:
    """Value from the first candidate band that exists, quality likewise, without touching the data."""
    band = next((c for c in candidates if c in df.columns), fallback)
    qa_band = next((c for c in qa_candidates if c in df.columns), None)
    return df.withColumns(
        {
            "value": F.col(band).cast("double"),
            "qa": F.col(qa_band).cast("double") if qa_band else F.lit(None).cast("double"),
            "band_used": F.lit(band),
            "qa_available": F.lit(int(qa_band is not None)),
        }
    )


__all__ = [
    "clip_and_mask",
    "first_available_band",
    "in_range_or_null",
    "missing_flags",
    "mode_in_range",
    "physical_range_mask",
    "qa_bits",
    "qa_filter",
    "qa_pass",
    "scale_offset_fill",
]
