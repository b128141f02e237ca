"""Time normalisation, calendar encodings and seasons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BURNING_MONTHS, DAYS_IN_CYCLE, HEATING_MONTHS, SEASONS


def normalize_time_utc(c: Column) -> Column:
    """Text or timestamp to the UTC calendar day; unreadable input becomes NULL.

    The session time zone is UTC, so a zone suffix in the text is honoured and then dropped.
    """
    return F.to_date(F.date_trunc("day", F.try_to_timestamp(c.cast("string"))))


def ensure_date_column(df: DataFrame, fallbacks: Sequence[str] = ("date_utc", "timestamp", "ts")) -> DataFrame:
    """Date from ``date``, else ``time``, else the first fallback column that exists."""
    source = next((c for c in ("date", "time", *fallbacks) if c in df.columns), None)
    if source is None:
        raise ValueError("no column to derive a date from")
    return df.withColumn("date", F.to_date(F.col(source)))


def season_label(month: Column, seasons: dict[str, list[int]] = SEASONS) -> Column:
    label = F.lit(None).cast("string")
    for name, months in seasons.items():
        label = F.when(month.isin(months), name).otherwise(label)
    return label


def calendar_encodings(df: DataFrame, date: str = "date", harmonics: int = 3) -> DataFrame:
    """Day of year, month, year, annual sin/cos harmonics and season flags; present columns stay."""
    d = F.col(date)
    angle = F.dayofyear(d) * F.lit(2 * math.pi / DAYS_IN_CYCLE)
    cols = {
        "day_of_year": F.dayofyear(d),
        "month": F.month(d),
        "year": F.year(d),
    }
    for k in range(1, harmonics + 1):
        suffix = "" if k == 1 else f"_{k}"
        cols[f"doy_sin{suffix}"] = F.sin(angle * k)
        cols[f"doy_cos{suffix}"] = F.cos(angle * k)
    cols["heating_season_flag"] = F.month(d).isin(HEATING_MONTHS).cast("int")
    cols["burning_season_flag"] = F.month(d).isin(BURNING_MONTHS).cast("int")
    return df.withColumns({n: c for n, c in cols.items() if n not in df.columns})
