"""Rolling features on the stream against the batch operators, over several batches with late days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hazeloom.operators import temporal
from hazeloom.operators.temporal import Lag, Roll
from hazeloom.session import scratch_path
from hazeloom.streaming import rolling, streams

SPECS = [Lag("pm25", 1), Lag("pm25", 7), *[Roll("pm25", s, n) for s in ("mean", "std", "min", "max", "sum") for n in (3, 14)]]
SCHEMA = "sensor_id bigint, ts timestamp, pm25 double"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_batches_with_late_days_equal_the_batch_answer(spark, rocksdb):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    days = [(s, start + dt.timedelta(days=i), None if rng.random() < 0.15 else round(rng.uniform(0, 90), 3)) for s in (1, 2, 3) for i in range(70) if rng.random() < (0.9 if s == 1 else 0.55)]
    base = scratch_path(spark, "rolling")
    run = lambda: streams.run_to_table(rolling.stream_rolling_features(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), SPECS), f"{base}/out", f"{base}/cp")
    # a day is sent up to five days after its turn, in one of five batches; some are sent twice
    batch = lambda d: min(4, ((d[1] - start).days + rng.randint(0, 5)) // 15)
    sent = [(batch(d), d) for d in days]
    sent += [(b, d) for b, d in sent if rng.random() < 0.1]
    for i in range(5):
        part = [d for b, d in sent if b == i]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = run()
    got = {(r.sensor_id, r.date): r for r in out.collect()}
    frame = spark.createDataFrame([(s, d.date(), v) for s, d, v in days], "sensor_id bigint, date date, pm25 double")
    batchwise = temporal.apply_specs(temporal.time_segments(frame), SPECS, temporal.within_segment())
    last = max(d[1] for d in days).date() - dt.timedelta(days=11)
    want = {(r.sensor_id, r.date): r for r in batchwise.where(F.col("date") <= F.lit(last)).collect()}
    assert set(got) == set(want) and len(got) > 80
    for k, r in want.items():
        for c in ["pm25", *[s.name for s in SPECS]]:
            assert got[k][c] == (None if r[c] is None else pytest.approx(r[c])), (k, c)


def test_ring_features():
    assert rolling.ring_features([1.0, None, 3.0], [Lag("pm25", 1), Lag("pm25", 2), Lag("pm25", 3)]) == [None, 1.0, None]
    mean, std = Roll("pm25", "mean", 3), Roll("pm25", "std", 3)
    assert rolling.ring_features([None, None, None], [mean, std]) == [None, None]
    assert rolling.ring_features([5.0, None, 7.0], [mean]) == [6.0] and rolling.ring_features([None, 5.0], [std]) == [None]
    assert rolling.ring_features([1.0] * 20, [Roll("pm25", "sum", 14)]) == [14.0]
