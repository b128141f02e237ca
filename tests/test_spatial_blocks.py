"""What spatial_block_eval fits: every block of every province, with the operator's own settings."""

import datetime as dt

from pyspark.sql import functions as F

from hazeloom.operators import models
from hazeloom.operators.models import TreeParams
from hazeloom.plans import REGISTRY, training


def test_spatial_block_eval_fits_all_blocks_in_full(spark, tmp_path, monkeypatch):
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2)]
    rows = [(1000 * d.day + u, d, u, "view", float(u % 9), None) for u in range(60) for d in days]
    types = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").select(
        *types.names
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").write.parquet(str(tmp_path / "region.parquet"))
    seen = {}

    def note(rows, folds, features, target="pm25", categories=(), params=TreeParams()):
        seen.update(rows=rows, folds=folds, features=features, params=params)
        return rows.limit(0)

    monkeypatch.setattr(models, "holdout_eval", note)
    REGISTRY["spatial_block_eval"].run(spark, str(tmp_path))
    assert seen["params"] == TreeParams() and seen["features"] == training.FEATURES
    provinces = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    assert [name for name, _, _ in seen["folds"]] == [f"{p} block {i}" for p in provinces for i in range(5)]
    tests = sum(test.cast("int") for _, _, test in seen["folds"])
    trains = sum(train.cast("int") for _, train, _ in seen["folds"])
    got = seen["rows"].agg(F.count("*"), F.min(tests), F.max(tests), F.min(trains), F.max(trains)).first()
    assert tuple(got) == (120, 1, 1, 24, 24)  # each row is held out by one fold and trains in all others
