"""Days of the stream are finished by an aggregate; what Python does to them grows with buckets, not with days."""

import datetime as dt

import numpy as np
import pandas as pd

from hazeloom.operators.temporal import Lag, Roll
from hazeloom.session import scratch_path
from hazeloom.streaming import rolling, streams

SCHEMA = "sensor_id bigint, ts timestamp, pm25 double"


def test_lag_stream_runs_without_python(spark):
    path = scratch_path(spark, "plan")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    plan = streams.stream_lag_features(spark.readStream.schema(SCHEMA).parquet(path))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Python" not in plan


def test_first_value_of_a_resent_day_counts(spark):
    base, t = scratch_path(spark, "resent"), dt.datetime
    run = lambda: streams.run_to_table(streams.stream_lag_features(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")), f"{base}/out", f"{base}/cp")
    for rows in ([(1, t(2024, 1, 1), None), (1, t(2024, 1, 2), 2.0), (None, t(2024, 1, 2), 3.0)], [(1, t(2024, 1, 1), 9.0), (1, t(2024, 1, 2), 8.0), (1, t(2024, 1, 13), 1.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = run()
    # the 2nd is over on the 3rd, ten days before the 13th
    assert sorted(tuple(r) for r in out.collect()) == [(1, dt.date(2024, 1, 1), None, None), (1, dt.date(2024, 1, 2), 2.0, None)]


class _Value:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value


class _Handle:
    def getValueState(self, name, schema):
        return _Value()


def test_a_bucket_is_answered_in_one_frame():
    days = rolling.RollingDays([Lag("pm25", 1), Roll("pm25", "mean", 3)], 2, "station")
    days.init(_Handle())
    give = lambda *rows: list(days.handleInputRows((0,), iter([pd.DataFrame([r], columns=["sensor_id", "day", "pm25"]) for r in rows]), None))
    (first,) = give((7, 2, 4.0), (5, 1, 1.0), (7, 1, 2.0), (5, 9, 3.0))
    got = first.fillna(-1).values.tolist()
    assert got == [[5, 1, 1, -1, 1], [5, 9, 3, -1, 3], [7, 1, 2, -1, 2], [7, 2, 4, 2, 3]]
    (second,) = give((7, 4, np.nan), (6, 3, 5.0))
    assert second.fillna(-1).values.tolist() == [[6, 3, 5, -1, 5], [7, 4, -1, 4, 3]]
    # no more than the longest window of each station's last segment is kept
    assert days.answered.kept[:2] == ([5, 6, 7, 7, 7], [9, 3, 1, 2, 4])
    (third,) = give((7, 5, 1.0))
    assert third.fillna(-1).values.tolist() == [[7, 5, 1, -1, 2.5]] and days.answered.kept[1] == [9, 3, 2, 4, 5]
