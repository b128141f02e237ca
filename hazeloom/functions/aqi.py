"""Air-quality index, categories and training weights derived from concentrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AQI_BANDS, AQI_CATEGORY_LABELS, AQI_CATEGORY_UPPER


def pm25_to_aqi(pm25: Column, bands: Sequence[tuple] = AQI_BANDS) -> Column:
    """Piecewise-linear index of the concentration cut to one decimal; NULL above the last band."""
    c = F.floor(pm25 * 10).cast("double") / 10.0
    index = F.lit(None).cast("double")
    for c_low, c_high, i_low, i_high in reversed(list(bands)):
        slope = (i_high - i_low) / (c_high - c_low)
        index = F.when(c.between(c_low, c_high), (c - c_low) * slope + float(i_low)).otherwise(index)
    return index


def aqi_category(pm25: Column, upper: Sequence[float] = AQI_CATEGORY_UPPER) -> Column:
    """Category number; each band includes its upper bound."""
    category = F.lit(len(upper))
    for i, bound in reversed(list(enumerate(upper))):
        category = F.when(pm25 <= bound, i).otherwise(category)
    return F.when(pm25.isNotNull(), category)


def aqi_category_label(category: Column, labels: Sequence[str] = AQI_CATEGORY_LABELS) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), category)


def tail_weights(
    y: Column,
    steps: Sequence[tuple[float, float]] = ((100.0, 1.0), (150.0, 3.0), (200.0, 6.0)),
    cap: float = 12.0,
) -> Column:
    """Base weight 1 plus an increment for every threshold reached, capped."""
    total = F.lit(1.0)
    for threshold, increment in steps:
        total = total + F.when(y >= threshold, increment).otherwise(0.0)
    return F.least(total, F.lit(cap))


def group_weights(is_regulatory: Column, weight: float = 10.0) -> Column:
    return F.when(is_regulatory, weight).otherwise(1.0)
