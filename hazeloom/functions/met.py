"""Weather scalars: humidity, wind, clouds, mixing and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CALM_WIND_MS, STAGNANT_BLH_M
from ..semantics import flag


def _clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(float(hi))).otherwise(out)
    return out


def saturation_pressure(celsius: Column) -> Column:
    """Magnus form, hPa."""
    return 6.112 * F.exp(F.try_divide(17.67 * celsius, celsius + 243.5))


def thermo_features(t2m: Column, d2m: Column, sp: Column) -> dict[str, Column]:
    """Relative and specific humidity, vapour-pressure deficit, dew-point depression, potential temperature."""
    air, dew = t2m - 273.15, d2m - 273.15
    e_sat, e_act = saturation_pressure(air), saturation_pressure(dew)
    return {
        "RH": _clip(F.try_divide(100.0 * e_act, e_sat), 0, 100),
        "q": F.try_divide(0.622 * e_act, sp / 100.0 - 0.378 * e_act),
        "VPD": _clip(e_sat - e_act, 0),
        "dT": air - dew,
        "theta": t2m * F.pow(F.try_divide(F.lit(1e5), sp), F.lit(287.0 / 1004.0)),
    }


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees the wind blows from, clockwise from north."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def wind_features(u10: Column, v10: Column, u100: Column | None = None, v100: Column | None = None) -> dict[str, Column]:
    """Speed and direction at two heights and the shear between them; missing 100 m uses 10 m."""
    u_top = u10 if u100 is None else u100
    v_top = v10 if v100 is None else v100
    ws_low, wd_low = F.hypot(u10, v10), wind_direction(u10, v10)
    ws_top, wd_top = F.hypot(u_top, v_top), wind_direction(u_top, v_top)
    return {
        "WS10": ws_low,
        "WD10": wd_low,
        "WS100": ws_top,
        "WD100": wd_top,
        "dWS": ws_top - ws_low,
        "dWD": wrapped_difference(wd_top, wd_low),
    }


def wrapped_difference(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def clear_sky(df: DataFrame, tcc: str = "tcc", out: str = "CLR") -> DataFrame:
    """One minus cloud cover; cover given in percent (a maximum above 1.5) is scaled first."""
    top = df.agg(F.max(tcc)).scalar()
    return df.withColumn(out, _clip(1.0 - F.when(top > 1.5, F.col(tcc) / 100.0).otherwise(F.col(tcc)), 0, 1))


def shear_abs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_abs": F.abs(F.col(c)) for c in ("dWS", "dWD") if c in df.columns})


def core_met_backfill(df: DataFrame, cell: str, time: str) -> DataFrame:
    """Grid variant: derives wind, clear sky, day differences, shear and flags that are absent."""
    w = Window.partitionBy(cell).orderBy(time)

    def step(name: str) -> Column:
        return F.col(name) - F.lag(name).over(w)

    recipes = [
        ("WS10", ["u10", "v10"], lambda: F.hypot(F.col("u10"), F.col("v10"))),
        ("WS100", ["u100", "v100"], lambda: F.hypot(F.col("u100"), F.col("v100"))),
        ("WD10", ["u10", "v10"], lambda: wind_direction(F.col("u10"), F.col("v10"))),
        ("WD100", ["u100", "v100"], lambda: wind_direction(F.col("u100"), F.col("v100"))),
        ("CLR", ["tcc"], lambda: 1.0 - F.col("tcc")),
        ("BLH_tend", ["blh"], lambda: step("blh")),
        ("MSLP_tend", ["msl"], lambda: step("msl")),
        ("SP_tend", ["sp"], lambda: step("sp")),
        ("dT", ["t2m"], lambda: step("t2m")),
        ("dWS", ["WS10", "WS100"], lambda: F.col("WS100") - F.col("WS10")),
        ("dWD", ["WD10", "WD100"], lambda: F.col("WD100") - F.col("WD10")),
        ("Stagnant", ["WS10", "blh"], lambda: flag((F.col("WS10") < CALM_WIND_MS) & (F.col("blh") < STAGNANT_BLH_M))),
        ("HighRH", ["RH"], lambda: flag(F.col("RH") > 80.0)),
    ]
    out = df
    for name, needs, expr in recipes:
        if name not in out.columns and set(needs) <= set(out.columns):
            out = out.withColumn(name, expr())
    return out
