"""Rolling features of live station days: lags and trailing statistics, answered once a day can no longer change.

A day waits in an aggregate until the watermark has passed it. Then the days of a bucket of stations are answered
together: its state is the last answered days of each of its stations, no more than the longest window, and the days
that are done continue them, or start a new segment after a gap that ends one. So late days, and days that arrive in
another order, give what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import SEGMENT_GAP_DAYS
from ..operators.temporal import Lag, Roll
from ..semantics import min_periods
from .streams import finished_days

#: Buckets of stations. One holds the last days of some 530 stations where there are 540,000.
BUCKETS = 1024


def _statistic(stat: str, values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One statistic for each row of ``values``, of the ``known`` ones; rows without any are the caller's to leave out."""
    if stat in ("min", "max"):
        lowest = stat == "max"
        return getattr(np, stat)(np.where(known, values, -np.inf if lowest else np.inf), axis=1)
    total, n = np.where(known, values, 0.0).sum(axis=1), known.sum(axis=1)
    if stat == "sum":
        return total
    mean = total / np.maximum(n, 1)
    if stat == "mean":
        return mean
    off = np.where(known, values - mean[:, None], 0.0)
    return np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1))


def window_features(windows: np.ndarray, specs: Sequence[Lag | Roll], preset: str = "station") -> list[np.ndarray]:
    """Each spec's values for rows of windows, newest day first; NaN is an unknown value or none at all."""
    out = []
    for spec in specs:
        if isinstance(spec, Lag):
            out.append(windows[:, spec.days])
            continue
        values = windows[:, : spec.days]
        known = ~np.isnan(values)
        enough = known.sum(axis=1) >= max(min_periods(spec.days, preset), 2 if spec.stat == "std" else 1)
        out.append(np.where(enough, _statistic(spec.stat, values, known), np.nan))
    return out


def _length(specs: Sequence[Lag | Roll]) -> int:
    return max(s.days + isinstance(s, Lag) for s in specs)


def ring_features(ring: Sequence[float | None], specs: Sequence[Lag | Roll], preset: str = "station") -> list[float | None]:
    """Each spec's value for the last entry of a segment's days, oldest first; an unknown value is None."""
    window = np.full((1, _length(specs)), np.nan)
    newest = [np.nan if v is None else v for v in ring[::-1]][: window.shape[1]]
    window[0, : len(newest)] = newest
    return [None if np.isnan(v[0]) else float(v[0]) for v in window_features(window, specs, preset)]


class RollingDays(StatefulProcessor):
    """State of a bucket of stations: the last answered days of each, in order."""

    def __init__(self, specs: Sequence[Lag | Roll], max_gap_days: float, preset: str):
        self.specs, self.max_gap_days, self.preset, self.length = list(specs), max_gap_days, preset, _length(specs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answered = handle.getValueState("answered", "sensor_id array<bigint>, day array<int>, pm25 array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = pd.concat(list(rows), ignore_index=True)
        parts = [(done["sensor_id"].to_numpy("int64"), done["day"].to_numpy("int64"), done["pm25"].to_numpy("float64"))]
        old = 0
        if self.answered.exists():
            parts.insert(0, [np.array(v, t) for v, t in zip(self.answered.get(), ("int64", "int64", "float64"))])
            old = len(parts[0][0])
        sensor, day, value = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((day, sensor))
        sensor, day, value, new = sensor[order], day[order], value[order], order >= old

        at = np.arange(len(sensor))
        first = np.r_[True, (sensor[1:] != sensor[:-1]) | (day[1:] - day[:-1] > self.max_gap_days)]
        row = at - at[first][np.cumsum(first) - 1]  # number of the row in its segment
        windows = np.full((len(sensor), self.length), np.nan)
        for k in range(min(self.length, len(sensor))):
            windows[k:, k] = np.where(row[k:] >= k, value[: len(value) - k], np.nan)

        last = np.r_[sensor[1:] != sensor[:-1], True]  # the newest day of each station, whose segment goes on
        newest = at[last][np.cumsum(np.r_[0, last[:-1]])]
        keep = (newest - at < self.length) & (newest - at <= row[newest])
        self.answered.update((sensor[keep].tolist(), day[keep].tolist(), value[keep].tolist()))
        features = window_features(windows[new], self.specs, self.preset)
        columns = {"sensor_id": sensor[new], "day": day[new].astype("int32"), "pm25": value[new]}
        yield pd.DataFrame(columns | {s.name: v for s, v in zip(self.specs, features)})

    def close(self) -> None:
        pass


def stream_rolling_features(
    daily: DataFrame,
    specs: Sequence[Lag | Roll],
    delay: str = "10 days",
    max_gap_days: float = SEGMENT_GAP_DAYS,
    preset: str = "station",
    buckets: int = BUCKETS,
) -> DataFrame:
    """``specs`` of pm25 for station days that the watermark has passed; a resent (station, day) counts once.

    ``daily`` has (sensor_id, ts, pm25) with ``ts`` the day's timestamp. Windows count rows of the same segment, as in
    ``operators.temporal``; a segment ends with a gap of more than ``max_gap_days``. The number of ``buckets`` is part of
    the state and stays as it is for the life of a checkpoint. Needs the RocksDB state store.
    """
    # an unknown value is one that arrived
    days = finished_days(daily, delay, pm25=F.coalesce("pm25", F.lit(float("nan"))))
    bucket = F.pmod(F.hash("sensor_id"), F.lit(buckets))
    days = days.select(bucket.alias("bucket"), "sensor_id", F.unix_date(F.to_date("ts")).alias("day"), "pm25")
    schema = T.StructType([T.StructField("sensor_id", T.LongType()), T.StructField("day", T.IntegerType()), T.StructField("pm25", T.DoubleType())])
    for spec in specs:
        schema = schema.add(spec.name, T.DoubleType())
    found = days.groupBy("bucket").transformWithStateInPandas(RollingDays(specs, max_gap_days, preset), schema, "Append", "None")
    # an unknown value leaves pandas as NaN
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("sensor_id", F.date_from_unix_date("day").alias("date"), *[known(c) for c in ["pm25", *[s.name for s in specs]]])
