"""Many fits over one stored training table: monthly backtests, and blocks of provinces held out.

Features are binned once and stored with the folds of each row, as arrays of fold numbers: a fit reads the rows whose
``train`` array holds its fold, and no fold has a copy of the table. Missing values are a bin of their own, so nothing
is imputed per fold. Fits run a few at a time. Their predictions are written as they finish, one folder per fold, and
all metrics come from one pass over them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import PARALLEL, scratch_path, side_by_side, stored
from .evaluate import METRICS, metric_aggregates, persistence_baseline, skill_score
from .models import TreeParams
from .quantile import array_median
from .splits import hash_bucket

BINS = 32


@dataclass(frozen=True)
class FoldTable:
    """Stored rows (*kept, y, train, test, one vector column per variant); ``names`` are the folds by number."""

    rows: DataFrame
    names: Sequence[str]
    variants: Sequence[str]

    def sizes(self) -> DataFrame:
        """Rows (fold, n_train, n_test), from one scan."""
        part = lambda c: self.rows.select(F.explode(c).alias("i"), F.lit(c).alias("part"))
        counted = part("train").union(part("test")).groupBy("i").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "test")])
        names = self.rows.sparkSession.createDataFrame(list(enumerate(self.names)), "i int, fold string")
        some = names.join(counted, "i", "left")
        return some.select("fold", *[F.coalesce(f"n_{p}", F.lit(0).cast("long")).alias(f"n_{p}") for p in ("train", "test")])


def _edges(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Inner bin borders of every feature, from one pass; two values each at least, so that the bins are valid."""
    at = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 10_000).alias(f"_{i}") for i, c in enumerate(features)]).first()
    return [[-float("inf"), *sorted(set(found[i] or [0.0])), float("inf")] for i in range(len(features))]


def fold_table(
    rows: DataFrame,
    features: Sequence[str],
    folds: Mapping[str, tuple[Column, Column]],
    kept: Sequence[str],
    target: str = "pm25",
    variants: Mapping[str, Sequence[str]] | None = None,
    bins_from: Column | None = None,
) -> FoldTable:
    """Binned rows with their folds; ``folds`` gives each fold's conditions for training and test rows.

    ``variants`` names vectors by the categorical columns they add to the features (by default one, without any).
    ``bins_from`` limits the rows that place the bins, so that a backtest does not look ahead. Rows without a target
    are left out, and a null condition does not hold.
    """
    variants = variants or {"plain": ()}
    known = rows.where(F.col(target).isNotNull())
    splits = _edges(known if bins_from is None else known.where(bins_from), features)
    member = lambda side: F.array_compact(F.array(*[F.when(pair[side], F.lit(i)) for i, pair in enumerate(folds.values())]))
    labelled = known.withColumns({"_y": F.col(target).cast("double"), "_train": member(0), "_test": member(1)})
    labelled = labelled.where("size(_train) > 0 OR size(_test) > 0")
    doubles = {f"_d{i}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for i, c in enumerate(features)}
    binner = Bucketizer(splitsArray=splits, inputCols=list(doubles), outputCols=[f"_b{i}" for i in range(len(features))], handleInvalid="keep")
    binned = binner.transform(labelled.withColumns(doubles))
    binned = binned.withColumns({c: F.col(c) + 0.0 for c in binner.getOutputCols()})  # a sum is ordered, a bucket by itself a category
    for c in dict.fromkeys(c for cs in variants.values() for c in cs):
        binned = StringIndexer(inputCol=c, outputCol=f"_ix_{c}", handleInvalid="keep").fit(labelled).transform(binned)
    for name, categories in variants.items():
        inputs = [f"_b{i}" for i in range(len(features))] + [f"_ix_{c}" for c in categories]
        binned = VectorAssembler(inputCols=inputs, outputCol=f"_v_{name}").transform(binned)
    vectors = [f"_v_{name}" for name in variants]
    out = binned.select(*[F.col(c) for c in kept], F.col("_y").alias("y"), F.col("_train").alias("train"), F.col("_test").alias("test"), *vectors)
    return FoldTable(stored(out, "folds"), list(folds), list(variants))


def fold_predictions(table: FoldTable, params: TreeParams = TreeParams(), parallel: int = PARALLEL) -> DataFrame:
    """Stored rows (*kept, y, y_pred, variant, fold) of every fold that has training and test rows."""
    spark, root = table.rows.sparkSession, scratch_path(table.rows.sparkSession, "predictions")
    usable = {r.fold for r in table.sizes().where("n_train > 0 AND n_test > 0").collect()}
    kept = [c for c in table.rows.columns if c not in ("train", "test") and not c.startswith("_v_")]

    def run(job: tuple[int, str]) -> None:
        i, variant = job
        vector = f"_v_{variant}"
        trainer = GBTRegressor(
            labelCol="y", featuresCol=vector, lossType=params.loss, maxIter=params.rounds, maxDepth=params.depth,
            stepSize=params.step, subsamplingRate=params.subsample, seed=params.seed, maxBins=max(BINS + 2, 64),
        )
        model = trainer.fit(table.rows.where(F.array_contains("train", i)).select("y", vector))
        scored = model.transform(table.rows.where(F.array_contains("test", i)).select(*kept, vector))
        scored = scored.select(*kept, F.col("prediction").alias("y_pred"), F.lit(variant).alias("variant"), F.lit(table.names[i]).alias("fold"))
        scored.write.parquet(f"{root}/job={variant}-{i}")

    jobs = [(i, v) for i, name in enumerate(table.names) if name in usable for v in table.variants]
    side_by_side(spark, [partial(run, job) for job in jobs], parallel)
    if not jobs:
        none = [F.lit(None).cast("double").alias("y_pred"), F.lit("").alias("variant"), F.lit("").alias("fold")]
        return table.rows.where("false").select(*kept, *none)
    return spark.read.parquet(root).drop("job")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """One row of metrics for each fold and variant, from one pass."""
    return predictions.groupBy("fold", "variant").agg(*metric_aggregates(F.col("y"), F.col("y_pred")))


def _month_starts(start: str, end: str) -> list[dt.date]:
    at, last, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    while at <= last:
        out.append(at)
        at = at.replace(year=at.year + at.month // 12, month=at.month % 12 + 1)
    return out


def monthly_backtest(
    rows: DataFrame,
    features: Sequence[str],
    start: str,
    end: str,
    cutoff_days: int = 90,
    validation_days: int = 90,
    min_train_years: int = 2,
    target: str = "pm25",
    key: str = "sensor_id",
    date: str = "date",
    params: TreeParams = TreeParams(),
    parallel: int = PARALLEL,
) -> tuple[DataFrame, DataFrame]:
    """What monthly retraining would have given: (one row per reference date, the stored predictions).

    ``start`` is the first reference date, and its day of the month (28 at most) that of the others. For each, the
    waterline lies ``cutoff_days`` before it, validation rows are those of the ``validation_days`` up to the waterline,
    both ends included, and training rows all earlier ones. Besides the error metrics there are the mean of the
    stations' own errors and the skill against yesterday's value and against the median of the station's month in the
    training rows (null where no row has the reference). A reference date with fewer than ``min_train_years`` calendar
    years of training rows, or without validation rows, has its sizes and status ``skipped``.
    """
    spark = rows.sparkSession
    dates = _month_starts(start, end)
    lines = [(r, r - dt.timedelta(cutoff_days), r - dt.timedelta(cutoff_days + validation_days)) for r in dates]
    known = rows.where(F.col(target).isNotNull() & F.col(date).isNotNull())
    # one row per calendar day tells which folds can be fitted
    days = known.groupBy(date).agg(F.count("*").alias("n")).select(F.col(date).cast("date").alias("d"), "n").collect()
    sizes, folds = [], {}
    for reference, waterline, val_start in lines:
        before, inside = [r for r in days if r.d < val_start], [r for r in days if val_start <= r.d <= waterline]
        years, n_train, n_val = len({r.d.year for r in before}), sum(r.n for r in before), sum(r.n for r in inside)
        ok = years >= min_train_years and n_train > 0 and n_val > 0
        sizes.append((reference.isoformat(), waterline, val_start, n_train, n_val, years, "ok" if ok else "skipped"))
        if ok:
            d = F.col(date).cast("date")
            folds[reference.isoformat()] = (d < F.lit(val_start), d.between(F.lit(val_start), F.lit(waterline)))
    about = spark.createDataFrame(sizes, "fold string, waterline date, val_start date, n_train long, n_val long, train_years int, status string")
    first = min((s[2] for s in sizes if s[-1] == "ok"), default=dt.date.max)
    usable = F.col(date).cast("date") < F.lit(first) if folds else F.lit(True)
    table = fold_table(known, features, folds or {"none": (F.lit(False), F.lit(False))}, [key, date], target, bins_from=usable)
    predictions = fold_predictions(table, params, parallel)

    # references: yesterday's value, and the values of the station's month, at most 31 a year, before the fold's start
    history = known.select(key, date, F.col(target).alias("y"))
    judged = persistence_baseline(predictions, history, key, date, "y")
    months = history.groupBy(key, F.month(date).alias("_month")).agg(F.collect_list(F.struct(F.col(date).cast("date").alias("d"), "y")).alias("_past"))
    judged = judged.withColumn("_month", F.month(date)).join(months, [key, "_month"], "left").join(F.broadcast(about.select("fold", "val_start")), "fold")
    past = F.transform(F.filter("_past", lambda v: v["d"] < F.col("val_start")), lambda v: v["y"])
    judged = judged.select("fold", key, "y", "y_pred", "persistence", array_median(past).alias("climatology"))

    off = lambda c: F.abs(F.col(c) - F.col("y"))
    stations = judged.groupBy("fold", key).agg(F.avg(off("y_pred")).alias("mae")).groupBy("fold")
    balanced = stations.agg(F.avg("mae").alias("mae_station_balanced"), F.count("*").alias("n_stations"))
    plain = judged.groupBy("fold").agg(
        *metric_aggregates(F.col("y"), F.col("y_pred")), *[F.avg(off(c)).alias(f"mae_{c}") for c in ("persistence", "climatology")]
    )
    skills = {f"skill_vs_{c}": skill_score(F.col("mae"), F.col(f"mae_{c}")) for c in ("persistence", "climatology")}
    metrics = about.join(plain, "fold", "left").join(balanced, "fold", "left").withColumns(skills)
    names = ["waterline", "val_start", "status", "n_train", "n_val", "train_years", *METRICS[:-1], "n_stations", "mae_station_balanced"]
    more = [f"{p}_{c}" for p in ("mae", "skill_vs") for c in ("persistence", "climatology")]
    return metrics.select(F.col("fold").alias("reference_date"), *names, *more), predictions


def province_blocks(
    rows: DataFrame, province: str = "province", key: str = "sensor_id", date: str = "date", k: int = 5, test_days: int = 180, seed: int = 42
) -> dict[str, tuple[Column, Column]]:
    """Folds inside every province: ``k`` groups of stations, and the last ``test_days`` as a time block.

    Stations of a fold train nowhere in it; all other rows, of other provinces too, do. A time block trains on the rows
    of all provinces up to its cutoff. A province of fewer than max(2, k) stations has no station folds. Names of
    provinces are few; their last dates and numbers of stations come to the driver.
    """
    folds: dict[str, tuple[Column, Column]] = {}
    known = rows.where(F.col(province).isNotNull())
    for r in known.groupBy(province).agg(F.countDistinct(key).alias("n"), F.max(F.col(date).cast("date")).alias("last")).orderBy(province).collect():
        inside, name = F.coalesce(F.col(province) == r[0], F.lit(False)), r[0]
        if r.n >= max(2, k):
            for i in range(k):
                held = inside & F.coalesce(hash_bucket(F.col(key), k, seed) == i, F.lit(False))
                folds[f"{name}|stations|{i}"] = (~held, held)
        if r.last is not None:
            cutoff = F.lit(r.last - dt.timedelta(test_days))
            folds[f"{name}|time|0"] = (F.col(date).cast("date") <= cutoff, inside & (F.col(date).cast("date") > cutoff))
    return folds


def province_block_eval(
    rows: DataFrame,
    features: Sequence[str],
    province: str = "province",
    key: str = "sensor_id",
    date: str = "date",
    k: int = 5,
    test_days: int = 180,
    min_test_rows: int = 500,
    target: str = "pm25",
    seed: int = 42,
    params: TreeParams = TreeParams(),
    parallel: int = PARALLEL,
) -> tuple[DataFrame, DataFrame]:
    """(One row per fold of ``province_blocks``, the stored predictions): metrics without (base) and with (pool) the
    province as a feature, and their differences. Folds with fewer than ``min_test_rows`` test rows are left out."""
    known = rows.where(F.col(target).isNotNull())
    folds = province_blocks(known, province, key, date, k, test_days, seed)
    flags = [F.count_if(test).alias(f"_{i}") for i, (_, test) in enumerate(folds.values())]
    sizes = known.agg(*flags).first() if folds else []
    folds = {name: pair for (name, pair), n in zip(folds.items(), sizes) if n >= min_test_rows}
    table = fold_table(known, features, folds or {"none": (F.lit(False), F.lit(False))}, [key, date, province], target, {"base": (), "pool": (province,)})
    predictions = fold_predictions(table, params, parallel)
    one = fold_metrics(predictions).groupBy("fold").agg(
        *[F.max(F.when(F.col("variant") == v, F.col(m))).alias(f"{m}_{v}") for v in ("base", "pool") for m in ("r2", "rmse", "mae")]
    )
    deltas = {f"d_{m}": F.col(f"{m}_pool") - F.col(f"{m}_base") for m in ("r2", "rmse", "mae")}
    parts = F.split("fold", r"\|")
    named = one.join(table.sizes(), "fold").withColumns({**deltas, "province": F.get(parts, F.lit(0)), "split_mode": F.get(parts, F.lit(1)), "block": F.get(parts, F.lit(2)).cast("int")})
    return named.select("province", "split_mode", "block", "n_train", "n_test", *[c for c in one.columns if c != "fold"], *deltas), predictions


def block_summary(per_fold: DataFrame) -> DataFrame:
    """Means over the folds of each province and kind of block."""
    numbers = [c for c in per_fold.columns if c.endswith(("_base", "_pool")) or c.startswith("d_")]
    return per_fold.groupBy("province", "split_mode").agg(
        F.count("*").alias("n_folds"), F.sum("n_test").alias("n_test"), *[F.avg(c).alias(f"{c}_mean") for c in numbers]
    )
