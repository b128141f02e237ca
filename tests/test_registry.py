"""Every registered query against its SQL, and the ones without SQL for rows."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

from hazeloom.plans import REGISTRY

from .compare import differences, duck, spark_result, sql_result

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, folder, name):
    assert differences(spark_result(QUERIES[name](spark, folder)), sql_result(con, SQL[name])) is None


@pytest.mark.parametrize("name", ["train_gbt", "forest_quantiles", "two_stage_predict", "score_grid", "kmeans_blocks"])
def test_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.season for r in rows} <= {"winter", "pre_monsoon", "monsoon", "post_monsoon"}
    assert rows


@pytest.mark.parametrize("value,rows", [(1.0, 3), (50.0, 0)])
def test_snap_to_valid_without_valid_cells(spark, tmp_path, value, rows):
    at = dt.datetime(2024, 1, 1, 12)
    made = [(i, at, i, "view", value, None) for i in range(3)]
    types = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").select(
        *types.names
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").write.parquet(str(tmp_path / "region.parquet"))
    got = spark_result(REGISTRY["snap_to_valid"].run(spark, str(tmp_path)))
    assert len(got[1]) == rows
    con = duckdb.connect()
    for name in ("events", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert differences(got, sql_result(con, SQL["snap_to_valid"])) is None


def test_provider_dimension_keeps_shared_coordinates(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    repeat = 141 * 175  # users so far apart share a coordinate
    users = [(1, at), (1 + repeat, at + dt.timedelta(days=1)), (5, at), (5 + repeat, at), (2, at)]
    rows = [(i, u, t, "view", 1.0, None) for i, (u, t) in enumerate(users)]
    types = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    made = {"event_id": 0, "user_id": 1, "ts": 2, "event_type": 3, "value": 4}
    events = spark.createDataFrame([tuple(r[made.get(f.name, 5)] for f in types) for r in rows], types)
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").write.parquet(str(tmp_path / "region.parquet"))
    got = [r.provider for r in REGISTRY["provider_dimension"].run(spark, str(tmp_path)).collect()]
    assert sorted(got) == ["lowcost", "regulatory", "regulatory"]  # the later day's; of one day's the greater name; the lone one's


def test_sql_only_for_registered():
    assert set(SQL) <= set(QUERIES)
