"""The three end-to-end jobs: refresh a stage, build the master table, train and evaluate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.timecols import ensure_date_column
from .operators.assemble import join_stages
from .operators.evaluate import METRICS, metrics_by_period, skill_against, with_baselines
from .operators.models import Fitted, TreeParams, score_grid, train_gbt
from .operators.splits import year_split
from .session import cut_lineage, stored
from .sources.store import FeatureStore

# rows that the longest window or lag looks back
HISTORY_ROWS = 14


@dataclass(frozen=True)
class Refreshed:
    """Dates of a stage that a refresh added, wrote anew and removed."""

    added: int
    rewritten: int
    removed: int


def _fingerprints(observations: DataFrame, key: str) -> DataFrame:
    """Rows (date, key, digest) that change when an observation of the key and date does, whatever their order."""
    hashed = F.xxhash64(*[F.col(c) for c in sorted(observations.columns)]).cast("decimal(38,0)")
    return observations.groupBy("date", F.col(key).alias("key")).agg(F.sum(hashed).alias("digest"), F.count("*").alias("n"))


def refresh_stage(
    store: FeatureStore,
    stage: str,
    observations: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    history_rows: int = HISTORY_ROWS,
    key: str = "sensor_id",
    since: str | None = None,
) -> Refreshed:
    """Brings a stage up to date with its observations and writes no date that need not change.

    Beside the stage the store keeps a fingerprint of each key's observations per date. A (key, date) that is new,
    gone or different from its fingerprint changes that date, and the next ``history_rows`` rows of the key, which may
    look back at it; the dates of all these rows are computed and written again, any others are left alone. So late
    days, backfilled days, corrections and retractions end in the store that a full run would write, for every feature
    that looks back at most ``history_rows`` rows. A stage without fingerprints takes its stored dates as up to date.

    ``compute`` keeps a row for every date it is given. With ``since`` only observations from that date on are compared, so older partitions are read for history alone.
    A refresh that is interrupted is repeated by the next: fingerprints are written last.
    """
    spark, marks = store.spark, f"{stage}__inputs"
    observations = ensure_date_column(observations)
    recent = observations if since is None else observations.where(F.col("date") >= F.lit(since).cast("date"))
    now = stored(_fingerprints(recent, key), "fingerprints")
    if store.exists(marks):
        known = store.read(marks, since).select("date", "key", "digest", "n")
    else:
        kept = store.dates(stage) if store.exists(stage) else spark.createDataFrame([], "date date")
        known = now.join(kept, "date", "left_semi")
    known = known.select(F.col("date").alias("_date"), F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("n").alias("_n"))
    both = now.join(known, F.expr("date <=> _date AND key <=> _key"), "full").where("NOT (digest <=> _digest AND n <=> _n)")
    changed = stored(both.select(F.coalesce("date", "_date").alias("date"), F.coalesce("key", "_key").alias("key")), "changed")

    # one time line per key of its rows and its changes: a row is touched if a change is among the rows it may look back at
    line = observations.select("date", F.col(key).alias("key"), F.lit(False).alias("change")).union(changed.select("date", "key", F.lit(True)))
    line = line.groupBy("key", "date").agg(F.max("change").alias("change"), F.count_if(~F.col("change")).alias("rows"))
    by_key = Window.partitionBy("key").orderBy("date")
    line = line.withColumn("seen", F.sum("rows").over(by_key))
    last = F.max(F.when(F.col("change"), F.col("seen"))).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    touched = line.where("change").select("date").union(line.withColumn("last", last).where(f"rows > 0 AND seen - rows < last + {history_rows}").select("date"))
    touched = stored(touched.distinct(), "touched")  # at most one row per calendar day
    if touched.isEmpty():
        if not store.exists(marks):
            store.write(marks, now, overwrite=True)
        return Refreshed(0, 0, 0)

    # of each key the rows of these dates, and the rows before them that they look back at
    wanted = observations.join(touched.withColumn("_touched", F.lit(True)), "date", "left")
    ahead = Window.partitionBy(key).orderBy("date").rowsBetween(0, history_rows)
    scanned = wanted.withColumn("_needed", F.max("_touched").over(ahead)).where("_needed").drop("_touched", "_needed")
    fresh = compute(scanned).join(touched, "date", "left_semi")
    before = {r.date for r in store.dates(stage).collect()} if store.exists(stage) else set()
    written = {r.date for r in touched.collect()}
    store.write(stage, fresh, overwrite=True)
    left = {r.date for r in observations.join(touched, "date", "left_semi").select("date").distinct().collect()}
    gone = sorted(written - left)
    store.remove_dates(stage, gone)
    if store.exists(marks):
        store.write(marks, now.join(changed.select("date").distinct(), "date", "left_semi"), overwrite=True)
        store.remove_dates(marks, gone)
    else:
        store.write(marks, now, overwrite=True)
    return Refreshed(len(left - before), len(left & before), len(before & set(gone)))


def build_master(
    store: FeatureStore,
    base: DataFrame,
    stages: Mapping[str, Sequence[str]],
    keys: Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> int:
    """Joins the stored stages to the labelled rows and stores the result as ``master``.

    ``stages`` gives, per stage, the columns that decide between repeated keys.
    """
    frames = {name: store.read(name, start, end) for name in stages}
    return store.write("master", join_stages(base, frames, keys, stages), overwrite=True)


@dataclass(frozen=True)
class Report:
    model: Fitted
    metrics: DataFrame
    skill: DataFrame


def train_and_evaluate(
    rows: DataFrame,
    features: Sequence[str],
    train_years: Sequence[int],
    dev_years: Sequence[int],
    test_years: Sequence[int],
    params: TreeParams = TreeParams(),
    target: str = "pm25",
) -> Report:
    """Yearly split, boosted trees stopped on the development years, metrics by period, skill on the test years."""
    fitting = [y for y in train_years if y not in dev_years]
    split = cut_lineage(year_split(rows.where(F.col(target).isNotNull()), fitting, dev_years, test_years).where("split IS NOT NULL"))
    learn = split.where("split <> 'test'").withColumn("_val", F.col("split") == "dev")
    model = train_gbt(learn, features, target, val="_val", params=params)
    test = cut_lineage(model.predict(split.where("split = 'test'")))
    known = learn.select("sensor_id", "date", target)
    history = split.select("sensor_id", "date", target)
    both = with_baselines(test.select("sensor_id", "date", target, "y_pred"), known, history).withColumnRenamed(target, "y_true")
    return Report(model, metrics_by_period(both).select("scope", "key", *METRICS), skill_against(both, ["persistence", "climatology"]))


def score_range(store: FeatureStore, model: Fitted, cells: DataFrame, stages: Sequence[str], start: str, end: str) -> DataFrame:
    """Scores every grid cell of a date range in one job.

    ``cells`` has (cell_id, inside); the first stage decides which cell-days exist.
    """
    out = store.read(stages[0], start, end)
    for stage in stages[1:]:
        side = store.read(stage, start, end)
        out = out.join(side.drop(*[c for c in side.columns if c in out.columns and c not in ("cell_id", "date")]), ["cell_id", "date"], "left")
    masked = out.join(cells.select("cell_id", "inside"), "cell_id")
    return score_grid(model, masked, F.col("inside")).select("cell_id", "date", "pm25")
