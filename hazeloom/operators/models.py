"""Training, scoring and comparison of tree models with ``pyspark.ml``; every fit is distributed.

Models are fitted on imputed features; the medians come from the training rows only.  Data that several
fits share should be cut from its lineage first (``session.cut_lineage``).
"""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import group_weights
from ..session import cut_lineage, side_by_side, stored
from .assemble import fit_medians, median_impute
from .calibrate import daily_affine_apply, daily_affine_fit, daily_offset_apply, daily_offset_fit
from .evaluate import METRICS, cv_aggregate, evaluate_predictions
from .quantile import fold_medians
from .splits import hash_bucket

FEATURES_COL = "_features"


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 1.0
    loss: str = "absolute"
    seed: int = 42


@dataclass(frozen=True)
class Fitted:
    """A model with what is needed to score new rows: features, training medians, optional indexer."""

    model: object
    features: Sequence[str]
    medians: DataFrame
    indexers: Sequence[object] = field(default_factory=tuple)

    def assemble(self, df: DataFrame) -> DataFrame:
        out = median_impute(df, list(self.features), self.medians)
        inputs = list(self.features)
        for ix in self.indexers:
            out = ix.transform(out)
            inputs.append(ix.getOutputCol())
        return VectorAssembler(inputCols=inputs, outputCol=FEATURES_COL).transform(out)

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """The rows as given, plus the prediction; imputed copies of the features do not leak out."""
        kept = [F.col(c).alias(f"_raw_{c}") for c in self.features]
        scored = self.model.transform(self.assemble(df.select("*", *kept)))
        originals = [F.col(f"_raw_{c}").alias(c) if c in self.features else F.col(c) for c in df.columns]
        return scored.select(*originals, F.col("prediction").alias(out))


    def save(self, path: str) -> None:
        """Writes the model, its indexers, medians and feature list below ``path``, which any session can read."""
        spark = self.medians.sparkSession
        self.model.write().overwrite().save(f"{path}/model")
        for i, ix in enumerate(self.indexers):
            ix.write().overwrite().save(f"{path}/indexer-{i}")
        self.medians.write.mode("overwrite").parquet(f"{path}/medians")
        about = [(type(self.model).__name__, len(self.indexers), list(self.features))]
        spark.createDataFrame(about, "kind string, indexers int, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_fitted(spark, path: str) -> Fitted:
    """The model that ``Fitted.save`` wrote."""
    about = spark.read.schema("kind string, indexers int, features array<string>").json(f"{path}/about").first()
    kind = {c.__name__: c for c in (GBTRegressionModel, RandomForestRegressionModel)}[about.kind]
    indexers = tuple(StringIndexerModel.load(f"{path}/indexer-{i}") for i in range(about.indexers))
    return Fitted(kind.load(f"{path}/model"), tuple(about.features), spark.read.parquet(f"{path}/medians"), indexers)


def _training_table(train: DataFrame, features, target, weight, val, categories, medians) -> tuple[DataFrame, Fitted]:
    medians = cut_lineage(fit_medians(train, list(features))) if medians is None else medians
    indexers = tuple(
        StringIndexer(inputCol=c, outputCol=f"_ix_{c}", handleInvalid="keep").fit(train) for c in categories
    )
    shell = Fitted(None, tuple(features), medians, indexers)
    rows = shell.assemble(train.where(F.col(target).isNotNull()))
    extra = [F.col(weight).cast("double").alias("_w")] if weight else []
    extra += [F.col(val).cast("boolean").alias("_val")] if val else []
    return rows.select(F.col(target).cast("double").alias("_y"), FEATURES_COL, *extra), shell


def train_gbt(
    train: DataFrame,
    features: Sequence[str],
    target: str = "pm25",
    weight: str | None = None,
    val: str | None = None,
    categories: Sequence[str] = (),
    params: TreeParams = TreeParams(),
    medians: DataFrame | None = None,
) -> Fitted:
    """Boosted trees with absolute loss; rows flagged by ``val`` decide when to stop.

    Where none of the rows with a target is flagged, or all are, every round is fitted on all of them.
    """
    rows, shell = _training_table(train, features, target, weight, val, categories, medians)
    if val and any(rows.where(side).isEmpty() for side in ("_val", "NOT _val")):
        val = None
    trainer = GBTRegressor(
        labelCol="_y",
        featuresCol=FEATURES_COL,
        lossType=params.loss,
        maxIter=params.rounds,
        maxDepth=params.depth,
        stepSize=params.step,
        subsamplingRate=params.subsample,
        seed=params.seed,
        maxBins=64,
    )
    if weight:
        trainer.setWeightCol("_w")
    if val:
        trainer.setValidationIndicatorCol("_val")
    return replace(shell, model=trainer.fit(rows))


def train_forest(
    train: DataFrame,
    features: Sequence[str],
    target: str = "pm25",
    weight: str | None = None,
    trees: int = 20,
    depth: int = 8,
    seed: int = 42,
    medians: DataFrame | None = None,
) -> Fitted:
    rows, shell = _training_table(train, features, target, weight, None, (), medians)
    trainer = RandomForestRegressor(
        labelCol="_y", featuresCol=FEATURES_COL, numTrees=trees, maxDepth=depth, seed=seed, maxBins=64
    )
    if weight:
        trainer.setWeightCol("_w")
    return replace(shell, model=trainer.fit(rows))


def forest_quantiles(forest: Fitted, df: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of the single trees' predictions per row."""
    scored = forest.assemble(df)
    names = []
    for i, tree in enumerate(forest.model.trees):
        names.append(f"_tree{i}")
        scored = tree.copy().setPredictionCol(names[-1]).transform(scored)
    ordered = F.sort_array(F.array(*names))
    n = len(names)

    def at(p: float) -> Column:
        low = int(p * (n - 1))
        fraction = p * (n - 1) - low
        high = min(low + 1, n - 1)
        return F.get(ordered, F.lit(low)) * (1 - fraction) + F.get(ordered, F.lit(high)) * fraction

    return scored.select(*df.columns, *[at(p).alias(name) for name, p in probs.items()])


def feature_importance(fitted: Fitted, spark) -> DataFrame:
    """One row per model input."""
    names = [*fitted.features, *[ix.getInputCol() for ix in fitted.indexers]]
    values = fitted.model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scores(predicted: DataFrame, target: str, **labels) -> DataFrame:
    """One metrics row with labels, computed now: later fits do not repeat this one's scoring."""
    table = evaluate_predictions(predicted, y=target).select(*METRICS)
    for name, value in labels.items():
        table = table.withColumn(name, F.lit(value))
    return cut_lineage(table)


def _medians_of_folds(rows: DataFrame, features: Sequence[str], trains: Sequence[Column]) -> list[DataFrame]:
    """The training medians of each fold, all from the same passes over the rows."""
    found = stored(fold_medians(rows, list(features), trains), "medians")
    return [found.where(F.col("fold") == i).drop("fold") for i in range(len(trains))]


#: What the random search draws from.
SEARCH_SPACE = {
    "depth": (4, 5, 6, 8, 10),
    "step": (0.01, 0.02, 0.05, 0.1, 0.2),
    "subsample": (0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "rounds": (20, 50, 100, 200),
}


def sample_params(n: int, space: Mapping[str, Sequence] = SEARCH_SPACE, seed: int = 42, **fixed) -> list[TreeParams]:
    """Up to ``n`` different settings drawn from a grid without replacement."""
    names = list(space)
    total = math.prod(len(v) for v in space.values())
    out = []
    for code in random.Random(seed).sample(range(total), min(n, total)):
        drawn = {}
        for name in names:
            code, at = divmod(code, len(space[name]))
            drawn[name] = space[name][at]
        out.append(TreeParams(**{**drawn, **fixed}))
    return out


def random_search(
    rows: DataFrame,
    features: Sequence[str],
    folds: Sequence[tuple[Column, Column]],
    candidates: Sequence[TreeParams],
    target: str = "pm25",
) -> DataFrame:
    """Candidates over (train, validation) folds, best mean R2 first and lower MAE on ties."""
    medians = _medians_of_folds(rows, features, [train for train, _ in folds])

    def run(i: int, j: int) -> DataFrame:
        train, val = folds[j]
        fitted = train_gbt(rows.where(train), features, target, params=candidates[i], medians=medians[j])
        return _scores(fitted.predict(rows.where(val)), target, candidate=i, fold=j)

    jobs = [partial(run, i, j) for i in range(len(candidates)) for j in range(len(folds))]
    means = _union(side_by_side(rows.sparkSession, jobs)).groupBy("candidate").agg(*[F.avg(m).alias(m) for m in ("r2", "mae", "rmse")])
    return means.orderBy(F.desc("r2"), "mae", "candidate")


def compare_models(
    train: DataFrame, test: DataFrame, trainers: Mapping[str, Callable[[DataFrame], Fitted]], target: str = "pm25"
) -> DataFrame:
    """Several estimators on the same data, ranked by MAE; one that fails comes last, without metrics."""
    tables = []
    for name, fit in trainers.items():
        try:
            tables.append(_scores(fit(train).predict(test), target, model=name))
        except Exception as problem:  # whatever a foreign estimator raises
            warnings.warn(f"{name} failed: {problem}", stacklevel=2)
            empty = evaluate_predictions(test.where("false").withColumn("y_pred", F.lit(0.0)), y=target).select(*METRICS)
            tables.append(empty.select(*[F.lit(None).cast(t).alias(c) for c, t in empty.dtypes]).withColumn("model", F.lit(name)))
    return _union(tables).orderBy(F.asc_nulls_last("mae"), "model")


def feature_ablation(
    train: DataFrame,
    test: DataFrame,
    families: Mapping[str, Sequence[str]],
    winter: Column,
    target: str = "pm25",
    params: TreeParams = TreeParams(),
) -> DataFrame:
    """Full model, each family left out, and families added one by one; differences to the full model."""
    everything = [c for cols in families.values() for c in cols]
    runs: dict[str, list[str]] = {"full": everything}
    for name, cols in families.items():
        rest = [c for c in everything if c not in cols]
        if rest:
            runs[f"without_{name}"] = rest
    grown: list[str] = []
    for name, cols in families.items():
        grown = [*grown, *cols]
        runs[f"up_to_{name}"] = list(grown)
    medians = stored(fit_medians(train, everything), "medians")

    def measure(run: str) -> DataFrame:
        predicted = train_gbt(train, runs[run], target, params=params, medians=medians).predict(test)
        predicted = stored(predicted.select(target, "y_pred", winter.alias("_winter")), "predicted")
        return _union([_scores(predicted, target, experiment=run, scope="overall"), _scores(predicted.where("_winter"), target, experiment=run, scope="winter")])

    table = _union(side_by_side(train.sparkSession, [partial(measure, run) for run in runs]))
    full = table.where("experiment = 'full'").select(
        "scope", F.col("mae").alias("_mae"), F.col("r2").alias("_r2"), F.col("f1_150").alias("_f1")
    )
    # two rows, one per scope
    joined = table.join(F.broadcast(full), "scope")
    return joined.select(
        "experiment",
        "scope",
        "mae",
        "r2",
        "f1_150",
        (F.col("mae") - F.col("_mae")).alias("delta_mae"),
        (F.col("r2") - F.col("_r2")).alias("delta_r2"),
        (F.coalesce("f1_150", F.lit(0.0)) - F.coalesce("_f1", F.lit(0.0))).alias("delta_f1_150"),
    )


@dataclass(frozen=True)
class TwoStage:
    """Backbone on low-cost rows and a residual model on regulatory rows that sees the backbone's answer."""

    backbone: Fitted
    residual: Fitted

    def predict(self, df: DataFrame, weight: float = 1.0, out: str = "y_pred") -> DataFrame:
        staged = self.backbone.predict(df, "backbone_pred")
        corrected = self.residual.predict(staged, "_residual")
        return corrected.withColumn(out, F.col("backbone_pred") + weight * F.col("_residual")).drop("_residual")


def fit_backbone(lowcost: DataFrame, features, row_key: Column, target="pm25", params=TreeParams(), seed=42) -> Fitted:
    flagged = lowcost.withColumn("_es", hash_bucket(row_key, 100, seed) < 20)
    return train_gbt(flagged, features, target, val="_es", params=params)


def two_stage_fit(
    lowcost: DataFrame,
    regulatory: DataFrame,
    features: Sequence[str],
    row_key: Column,
    key: str = "sensor_id",
    target: str = "pm25",
    params: TreeParams = TreeParams(),
    seed: int = 42,
    backbone: Fitted | None = None,
) -> TwoStage:
    """A fifth of the rows, then a fifth of the stations, stop the two stages early.

    Both stages fill gaps with the medians of the low-cost rows.
    """
    if backbone is None:
        backbone = fit_backbone(lowcost, features, row_key, target, params, seed)
    base = backbone.predict(regulatory, "backbone_pred")
    residual_rows = base.withColumns(
        {"_target": F.col(target) - F.col("backbone_pred"), "_es": hash_bucket(F.col(key), 100, seed) < 20}
    )
    names = [*features, "backbone_pred"]
    residual = train_gbt(cut_lineage(residual_rows), names, "_target", val="_es", params=params, medians=backbone.medians)
    return TwoStage(backbone, residual)


def lambda_grid(predicted: DataFrame, backbone: str, residual: str, target: str = "pm25", steps: int = 11, step: float = 0.05):
    """MAE of backbone + lambda * residual for every lambda, best first, from one scan of stored predictions."""
    grid = F.array(*[F.lit(round(i * step, 10)) for i in range(steps)])
    error = F.abs(F.col(backbone) + F.col("lambda") * F.col(residual) - F.col(target))
    table = predicted.withColumn("lambda", F.explode(grid)).groupBy("lambda").agg(F.avg(error).alias("mae"))
    return table.orderBy("mae", "lambda")


def global_model(
    lowcost: DataFrame, regulatory: DataFrame, features, row_key: Column, target="pm25", params=TreeParams(), seed=42, medians=None
) -> Fitted:
    """One model on both networks."""
    both = lowcost.unionByName(regulatory).withColumn("_es", hash_bucket(row_key, 100, seed) < 20)
    return train_gbt(both, features, target, val="_es", params=params, medians=medians)


def weighted_global(
    lowcost: DataFrame,
    regulatory: DataFrame,
    features,
    row_key: Column,
    weight: float = 10.0,
    target="pm25",
    params=TreeParams(),
    seed=42,
    medians=None,
) -> Fitted:
    """Both networks with regulatory rows weighted up."""
    parts = [d.withColumn("_reg", F.lit(r)) for d, r in ((lowcost, False), (regulatory, True))]
    both = parts[0].unionByName(parts[1]).withColumns(
        {"_rw": group_weights(F.col("_reg"), weight), "_es": hash_bucket(row_key, 100, seed) < 20}
    )
    return train_gbt(both, features, target, weight="_rw", val="_es", params=params, medians=medians)


def anchor_only(
    regulatory: DataFrame, features, key: str = "sensor_id", target="pm25", params=TreeParams(), seed=42, medians=None
) -> Fitted:
    """Regulatory rows alone, a fifth of the stations stopping early."""
    flagged = regulatory.withColumn("_es", hash_bucket(F.col(key), 100, seed) < 20)
    return train_gbt(flagged, features, target, val="_es", params=params, medians=medians)


def alignment_fold(
    lowcost: DataFrame,
    train: DataFrame,
    anchors: DataFrame,
    test: DataFrame,
    backbone: Fitted,
    row_key: Column,
    target: str = "pm25",
    params: TreeParams = TreeParams(),
) -> DataFrame:
    """Metrics of the nine alignment approaches on one fold, one row each.

    ``anchors`` are the rows that calibrate the days of the test rows.
    """
    common = {"target": target, "params": params, "medians": backbone.medians}
    features = list(backbone.features)
    fits = {
        "two_stage": partial(two_stage_fit, lowcost, train, features, row_key, target=target, params=params, backbone=backbone),
        "anchor_only": partial(anchor_only, train, features, **common),
        "global": partial(global_model, lowcost, train, features, row_key, **common),
        "weighted_global": partial(weighted_global, lowcost, train, features, row_key, **common),
    }
    models = dict(zip(fits, side_by_side(train.sparkSession, list(fits.values()))))
    plain = {name: models[name] for name in ("two_stage", "anchor_only")}
    calibrated = {"backbone": backbone, "global": models["global"], "weighted_global": models["weighted_global"]}
    answers = {name: model.predict(test).select(target, "y_pred") for name, model in plain.items()}
    for name, model in calibrated.items():
        predicted = cut_lineage(model.predict(test).select("date", target, "y_pred"))
        anchor = cut_lineage(model.predict(anchors).select("date", target, "y_pred"))
        shifted = daily_offset_apply(predicted, daily_offset_fit(anchor, y=target))
        answers[name] = predicted
        answers[f"{name}_daily_offset"] = shifted.withColumn("y_pred", F.col("calibrated"))
        if name == "backbone":
            line = daily_affine_apply(predicted, daily_affine_fit(anchor, y=target))
            answers["daily_affine"] = line.withColumn("y_pred", F.col("calibrated"))
    together = _union([d.select(F.lit(n).alias("approach"), target, "y_pred") for n, d in answers.items()])
    return cut_lineage(evaluate_predictions(together, ["approach"], y=target))


def alignment_cv(
    lowcost: DataFrame,
    regulatory: DataFrame,
    features: Sequence[str],
    row_key: Column,
    k: int = 5,
    seed: int = 42,
    key: str = "sensor_id",
    target: str = "pm25",
    params: TreeParams = TreeParams(),
) -> DataFrame:
    """Alignment approaches over station folds: mean and population deviation per approach.

    The backbone and the medians depend on the low-cost rows alone and are fitted once.
    """
    fold = hash_bucket(F.col(key), k, seed)
    backbone = fit_backbone(lowcost, features, row_key, target, params, seed)
    tables = []
    for i in range(k):
        train, test = regulatory.where(fold != i), regulatory.where(fold == i)
        one = alignment_fold(lowcost, train, train, test, backbone, row_key, target, params)
        tables.append(one.withColumn("fold", F.lit(i)))
    return _union(tables).groupBy("approach").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in ("mae", "rmse", "r2")],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in ("mae", "rmse", "r2")],
        F.sum("n_predictions").alias("n"),
    )


def nested_alignment(
    lowcost: DataFrame,
    regulatory: DataFrame,
    features: Sequence[str],
    row_key: Column,
    months: Sequence[str],
    k: int = 5,
    seed: int = 42,
    key: str = "sensor_id",
    date: str = "date",
    target: str = "pm25",
    params: TreeParams = TreeParams(),
) -> DataFrame:
    """Alignment approaches with earlier months of other stations as training, the test month of the
    other stations as anchors, and the test month of the held-out stations as test."""
    fold, month = hash_bucket(F.col(key), k, seed), F.date_format(date, "yyyy-MM")
    backbone = fit_backbone(lowcost, features, row_key, target, params, seed)
    tables = []
    for test_month in list(months)[1:]:
        for i in range(k):
            train = regulatory.where((fold != i) & (month < test_month))
            anchors = regulatory.where((fold != i) & (month == test_month))
            test = regulatory.where((fold == i) & (month == test_month))
            one = alignment_fold(lowcost, train, anchors, test, backbone, row_key, target, params)
            tables.append(one.withColumns({"month": F.lit(test_month), "fold": F.lit(i)}))
    per_month = _union(tables).groupBy("approach", "month").agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "r2")])
    return per_month.groupBy("approach").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in ("mae", "rmse", "r2")],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in ("mae", "rmse", "r2")],
    )


def holdout_eval(
    rows: DataFrame,
    folds: Sequence[tuple[str, Column, Column]],
    features: Sequence[str],
    target: str = "pm25",
    categories: Sequence[str] = (),
    params: TreeParams = TreeParams(),
) -> DataFrame:
    """One fit per (name, train, test) fold and its metrics: provinces, spatial blocks or stations held out."""
    medians = _medians_of_folds(rows, features, [train for _, train, _ in folds])

    def run(i: int) -> DataFrame:
        name, train, test = folds[i]
        fitted = train_gbt(rows.where(train), features, target, categories=categories, params=params, medians=medians[i])
        return _scores(fitted.predict(rows.where(test)), target, fold=name)

    return _union(side_by_side(rows.sparkSession, [partial(run, i) for i in range(len(folds))]))


def yearly_rolling_cv(
    rows: DataFrame, features: Sequence[str], years: Sequence[int], target: str = "pm25", params: TreeParams = TreeParams(), date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """A fit on all earlier years for each validation year, its metrics per fold, and their mean and deviation.

    Years without rows, or without earlier ones, are skipped.
    """
    present = {r.y for r in rows.where(F.col(target).isNotNull()).select(F.year(date).alias("y")).distinct().collect()}
    usable = [y for y in years if y in present and min(present) < y]
    folds = [(str(y), F.year(date) < y, F.year(date) == y) for y in usable]
    metrics = holdout_eval(rows, folds, features, target, params=params)
    return metrics, cv_aggregate(metrics, [c for c in METRICS if c != "n_predictions"])


def score_grid(model: Fitted, cells: DataFrame, inside: Column, out: str = "pm25") -> DataFrame:
    """Predictions for all cells of a date range in one job; outside NULL, never below zero."""
    scored = model.predict(cells, "_p")
    return scored.withColumn(out, F.when(inside, F.greatest("_p", F.lit(0.0)))).drop("_p")


def score_validation_pair(model: Fitted, rows: DataFrame, history: Sequence[str], back: Callable[[Column], Column] = F.expm1) -> DataFrame:
    """Predictions with and without the history block, transformed back from the training scale."""
    with_history = model.predict(rows, "_a")
    blanked = with_history.select(
        *[F.lit(None).cast("double").alias(c) if c in history else F.col(c) for c in rows.columns], "_a",
        *[F.col(c).alias(f"_keep_{c}") for c in history],
    )
    both = model.predict(blanked, "_b").drop(*history).withColumnsRenamed({f"_keep_{c}": c for c in history})
    return both.withColumns({"pred_with_history": back(F.col("_a")), "pred_no_history": back(F.col("_b"))}).drop("_a", "_b")
