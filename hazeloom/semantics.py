"""Null, rounding and window-minimum conventions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that comparisons behave alike in every operator."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def nonfinite_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def coerce_numeric(c: Column) -> Column:
    """Number or NULL; text such as 'inf' counts as missing."""
    return finite(c.try_cast("double"))


def flag(condition: Column) -> Column:
    """0/1 flag in which an unknown input counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def min_periods(window: int, preset: str = "station") -> int:
    """Non-null rows a rolling window needs: half the window, rounded down (station) or up (grid)."""
    half = window // 2 if preset == "station" else -(-window // 2)
    return max(1, half)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Requested columns that exist, in the requested order."""
    have = set(df.columns)
    return [c for c in columns if c in have]
