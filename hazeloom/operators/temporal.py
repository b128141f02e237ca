"""Station and cell time series: gap-aware segments, lags, rolling statistics, carried values.

All of these take one row per (key, day): a window partition then holds at most one row per calendar
day however many raw readings a station sends.  Raw readings are aggregated to days first, which
combines map-side, so a busy station costs no more here than a quiet one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..constants import CALM_WIND_MS, SEGMENT_GAP_DAYS, STAGNANT_BLH_M
from ..functions.timecols import calendar_encodings
from ..semantics import flag, min_periods

SEGMENT = "segment"


def series(key: str | Sequence[str], time: str) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(time)


def days_since_previous(time: str, w: WindowSpec) -> Column:
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(86_400_000_000.0)
    return seconds - F.lag(seconds).over(w)


def gap_days(df: DataFrame, key: str = "sensor_id", time: str = "date") -> DataFrame:
    return df.withColumn("dt_days", days_since_previous(time, series(key, time)))


def time_segments(
    df: DataFrame,
    key: str | Sequence[str] = "sensor_id",
    time: str = "date",
    max_gap_days: float = SEGMENT_GAP_DAYS,
    out: str = SEGMENT,
) -> DataFrame:
    """Segment number per key, starting at 1 and growing where the gap exceeds the limit strictly."""
    w = series(key, time)
    gap = days_since_previous(time, w)
    starts = (gap.isNull() | (gap > max_gap_days)).cast("int")
    return df.withColumn("_starts", starts).withColumn(out, F.sum("_starts").over(w)).drop("_starts")


def within_segment(key: str = "sensor_id", time: str = "date") -> WindowSpec:
    return series([key, SEGMENT], time)


_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(value: Column, stat: str, window: int, w: WindowSpec, min_count: int) -> Column:
    """Trailing statistic over the last ``window`` rows; NULL below ``min_count`` known values."""
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(frame) >= min_count, _STATS[stat](value).over(frame))


@dataclass(frozen=True)
class Lag:
    source: str
    days: int

    @property
    def name(self) -> str:
        return f"{self.source}_lag{self.days}d"


@dataclass(frozen=True)
class Roll:
    source: str
    stat: str
    days: int

    @property
    def name(self) -> str:
        return f"{self.source}_roll{self.stat}_{self.days}d"


@dataclass(frozen=True)
class Anomaly:
    """Value minus its own rolling mean."""

    source: str
    days: int

    @property
    def name(self) -> str:
        return f"{self.source}_anom_{self.days}d"


def _tendency_specs() -> list:
    return [Roll(c, s, n) for c in ("BLH_tend", "MSLP_tend", "SP_tend", "dT") for n in (3, 7) for s in ("mean", "std")]


LEVEL2_SPECS: list = [
    Lag("WS10", 1),
    Lag("WS10", 3),
    Roll("WS10", "mean", 3),
    Roll("WS10", "std", 3),
    Roll("WS10", "min", 7),
    Roll("WS10", "max", 7),
    Lag("blh", 1),
    Lag("blh", 3),
    Roll("blh", "mean", 3),
    Roll("blh", "min", 7),
    Roll("blh", "mean", 7),
    Anomaly("blh", 7),
    Roll("blh", "mean", 14),
    Anomaly("blh", 14),
    Roll("RH", "mean", 3),
    Roll("RH", "max", 7),
    Roll("RH", "mean", 7),
    Anomaly("RH", 7),
    Roll("RH", "std", 7),
    Roll("VPD", "mean", 3),
    Roll("VPD", "mean", 7),
    Roll("VC", "mean", 3),
    Roll("VC", "min", 7),
    Roll("VC", "mean", 7),
    Anomaly("VC", 7),
    Roll("VC", "mean", 14),
    Anomaly("VC", 14),
    Roll("dWS", "mean", 3),
    Roll("dWS", "std", 3),
    Roll("dWD", "std", 3),
    *_tendency_specs(),
]


def spec_column(spec, w: WindowSpec, preset: str) -> Column:
    value = F.col(spec.source)
    if isinstance(spec, Lag):
        return F.lag(value, spec.days).over(w)
    mean_or_stat = "mean" if isinstance(spec, Anomaly) else spec.stat
    rolled = rolling(value, mean_or_stat, spec.days, w, min_periods(spec.days, preset))
    return value - rolled if isinstance(spec, Anomaly) else rolled


def apply_specs(df: DataFrame, specs: Sequence, w: WindowSpec, preset: str = "station") -> DataFrame:
    """All spec columns whose source exists, in one projection over one window."""
    return df.withColumns({s.name: spec_column(s, w, preset) for s in specs if s.source in df.columns})


def segment_lag(df: DataFrame, columns: Sequence[str], days: Sequence[int], key: str = "sensor_id", time: str = "date"):
    return apply_specs(df, [Lag(c, d) for c in columns for d in days], within_segment(key, time))


def segment_rolling(df: DataFrame, specs: Sequence[Roll], key: str = "sensor_id", time: str = "date", preset: str = "station"):
    return apply_specs(df, specs, within_segment(key, time), preset)


def rolling_anomaly(df: DataFrame, specs: Sequence[Anomaly], key: str = "sensor_id", time: str = "date", preset: str = "station"):
    return apply_specs(df, specs, within_segment(key, time), preset)


def gap_safe_rolling(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    window: int,
    stat: str = "mean",
    max_gap_days: int = 1,
    min_count: int = 1,
) -> DataFrame:
    """Rolling statistic that restarts after a gap of more whole days than allowed."""
    segmented = time_segments(df, keys, time, float(max_gap_days), out="_seg")
    w = series([*keys, "_seg"], time)
    cols = {f"{c}_roll_{stat}_{window}d": rolling(F.col(c), stat, window, w, min_count) for c in columns}
    return segmented.withColumns(cols).drop("_seg")


def _event_counts(df: DataFrame, event: Column, prefix: str, w: WindowSpec, preset: str) -> DataFrame:
    needed = {3: 2, 7: 5}
    counts = {
        f"{prefix}{n}_count": rolling(event, "sum", n, w, min_periods(n, preset)) for n in needed
    }
    flags = {f"{prefix}{n}_flag": flag(F.col(f"{prefix}{n}_count") >= k) for n, k in needed.items()}
    return df.withColumns(counts).withColumns(flags)


def calm_counts(df: DataFrame, w: WindowSpec, preset: str = "station") -> DataFrame:
    """Calm days among the last 3 and 7, and whether they are at least 2 and 5."""
    return _event_counts(df, flag(F.col("WS10") < CALM_WIND_MS), "calm", w, preset)


def stagnation_counts(df: DataFrame, w: WindowSpec, preset: str = "station") -> DataFrame:
    still = flag((F.col("WS10") < CALM_WIND_MS) & (F.col("blh") < STAGNANT_BLH_M))
    return _event_counts(df, still, "stagnant", w, preset)


def wind_direction_variance(df: DataFrame, w: WindowSpec, preset: str = "station") -> DataFrame:
    """Mean sine and cosine over 7 and 14 days and the circular variance."""
    angle = F.radians("WD10")
    out = df.withColumns({"WD10_sin": F.sin(angle), "WD10_cos": F.cos(angle)})
    means = {
        f"WD10_{part}_rm_{n}d": rolling(F.col(f"WD10_{part}"), "mean", n, w, min_periods(n, preset))
        for n in (7, 14)
        for part in ("sin", "cos")
    }
    out = out.withColumns(means)
    for n in (7, 14):
        s, c = F.col(f"WD10_sin_rm_{n}d"), F.col(f"WD10_cos_rm_{n}d")
        spread = 1.0 - F.sqrt(s * s + c * c)
        out = out.withColumn(f"WD10_var_{n}d", F.when(spread < 0, 0.0).when(spread > 1, 1.0).otherwise(spread))
    return out


def tendency_rolls(df: DataFrame, w: WindowSpec, preset: str = "station") -> DataFrame:
    """Rolling tendencies and shear, with the absolute shear."""
    shear = [Roll("dWS", "mean", 3), Roll("dWS", "std", 3), Roll("dWD", "std", 3)]
    out = df.withColumns({f"{c}_abs": F.abs(F.col(c)) for c in ("dWS", "dWD") if c in df.columns})
    return apply_specs(out, [*shear, *_tendency_specs()], w, preset)


def met_level2(df: DataFrame, key: str = "sensor_id", time: str = "date", preset: str = "station") -> DataFrame:
    """All weather history features; a missing source drops the features derived from it."""
    out = calendar_encodings(time_segments(df, key, time), time)
    w = within_segment(key, time)
    have = set(df.columns)
    if {"dWS", "dWD"} & have:
        out = out.withColumns({f"{c}_abs": F.abs(F.col(c)) for c in ("dWS", "dWD") if c in have})
    out = apply_specs(out, LEVEL2_SPECS, w, preset)
    if "WS10" in have:
        out = calm_counts(out, w, preset)
    if {"WS10", "blh"} <= have:
        out = stagnation_counts(out, w, preset)
    if "WD10" in have:
        out = wind_direction_variance(out, w, preset)
    return gap_days(out, key, time).drop(SEGMENT)


def causal_tendency(df: DataFrame, column: str, key: str | Sequence[str], time: str, out: str) -> DataFrame:
    """Hourly derivative of the trailing three-step mean; the first step is NULL."""
    w = series(key, time)
    smooth = df.withColumn("_s", F.avg(column).over(w.rowsBetween(-2, 0)))
    hours = days_since_previous(time, w) * 24.0
    return smooth.withColumn(out, (F.col("_s") - F.lag("_s").over(w)) / hours).drop("_s")


def day_difference(df: DataFrame, columns: Sequence[str], key: str = "sensor_id", time: str = "date") -> DataFrame:
    w = series(key, time)
    return df.withColumns({f"{c}_diff": F.col(c) - F.lag(c).over(w) for c in columns})


def forward_fill(df: DataFrame, columns: Sequence[str], key: str = "sensor_id", time: str = "date") -> DataFrame:
    frame = series(key, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in columns})


def history_features(df: DataFrame, start, end, history_days: int = 21, key: str = "sensor_id", time: str = "date"):
    """Grid-preset history features for every day of a range from one scan widened by the history.

    Each day sees its own ``history_days`` of past and nothing else, in windows, segments and filled tendencies: a
    row is handed to every day of the range that can see it, so an answer does not depend on the range asked for.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    scanned = df.where(F.col(time).between(F.date_sub(first, history_days), last))
    seeing = F.sequence(F.greatest(F.col(time), first), F.least(F.date_add(F.col(time), history_days), last))
    sliced = scanned.withColumn("_day", F.explode(seeing)).withColumn("_slice", F.struct(key, "_day"))
    featured = met_level2(sliced, "_slice", time, preset="grid")
    tendencies = [c for c in ("BLH_tend", "MSLP_tend", "SP_tend", "dT") if c in df.columns]
    return forward_fill(featured, tendencies, "_slice", time).where(F.col(time) == F.col("_day")).drop("_day", "_slice")


def target_lags(df: DataFrame, target: str = "pm25", lags: Sequence[int] = (1, 2, 3, 7), key="sensor_id", time="date"):
    w = series(key, time)
    return df.withColumns({f"{target}_lag{k}": F.lag(target, k).over(w) for k in lags})


def target_rolls(df: DataFrame, target: str = "pm25", key: str = "sensor_id", time: str = "date") -> DataFrame:
    """Means over the 3 and 7 rows before today and the deviation over 3; today is never included."""
    w = series(key, time)

    def before_today(n: int, stat, least: int) -> Column:
        frame = w.rowsBetween(-n, -1)
        return F.when(F.count(target).over(frame) >= least, stat(target).over(frame))

    return df.withColumns(
        {
            f"{target}_rollmean_3": before_today(3, F.avg, 1),
            f"{target}_rollmean_7": before_today(7, F.avg, 1),
            f"{target}_rollstd_3": before_today(3, F.stddev_samp, 2),
        }
    )


def nearest_time(df: DataFrame, keys: Sequence[str], time: str, at: Column, values: Sequence[str]) -> DataFrame:
    """Row of each group closest in time to ``at``; the earlier row wins a tie."""
    distance = F.abs(F.unix_micros(F.col(time)) - F.unix_micros(at))
    picked = F.min_by(F.struct(time, *values), F.struct(distance, F.col(time)))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")
