"""Prediction metrics, reference baselines and skill: conditional aggregates, one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXTREME_UGM3
from ..functions.timecols import season_label
from ..semantics import safe_ratio
from .quantile import exact_quantiles

METRICS = ["rmse", "mae", "r2", "bias", "f1_150", "extreme_rmse", "n_extreme_true", "n_extreme_pred", "n_predictions"]


def metric_aggregates(y: Column, p: Column, threshold: float = EXTREME_UGM3, empty_f1: float | None = 0.0) -> list[Column]:
    """Error metrics over rows where both values are known.

    ``empty_f1`` is the score without any true extreme; variance uses the centred population form.
    """
    known = y.isNotNull() & p.isNotNull()
    t, q = F.when(known, y), F.when(known, p)
    err = q - t
    high_t, high_q = t >= threshold, q >= threshold
    n_true = F.count(F.when(high_t, 1))
    n_pred = F.count(F.when(high_q, 1))
    hits = F.count(F.when(high_t & high_q, 1))
    spread = F.var_pop(t) * F.count(t)
    f1 = F.when(n_true == 0, F.lit(empty_f1).cast("double")).otherwise(2.0 * hits / (n_true + n_pred))
    return [
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1.0 - safe_ratio(F.sum(err * err), spread)).alias("r2"),
        F.avg(err).alias("bias"),
        F.when(F.count(t) > 0, f1).alias("f1_150"),
        F.sqrt(F.avg(F.when(high_t, err * err))).alias("extreme_rmse"),
        n_true.alias("n_extreme_true"),
        n_pred.alias("n_extreme_pred"),
        F.count(t).alias("n_predictions"),
    ]


def evaluate_predictions(
    df: DataFrame,
    by: Sequence[str | Column] = (),
    y: str = "y_true",
    p: str = "y_pred",
    extra: Sequence[Column] = (),
    empty_f1: float | None = 0.0,
) -> DataFrame:
    return df.groupBy(*by).agg(*metric_aggregates(F.col(y), F.col(p), empty_f1=empty_f1), *extra)


def metrics_by_period(df: DataFrame, month: str = "month", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Overall, monthly and seasonal metrics from one scan and one shuffle (grouping sets)."""
    named = df.select(F.col(month).alias("month"), season_label(F.col(month)).alias("season"), y, p)
    sets = [[], [F.col("month")], [F.col("season")]]
    level = F.grouping_id("month", "season")
    scope = F.when(level == 3, "overall").when(level == 1, "month").otherwise("season")
    out = named.groupingSets(sets, "month", "season").agg(scope.alias("scope"), *metric_aggregates(F.col(y), F.col(p)))
    return out.select("scope", F.coalesce(F.col("month").cast("string"), "season", F.lit("all")).alias("key"), *METRICS)


def metrics_by_station(df: DataFrame, key: str = "sensor_id", min_rows: int = 30) -> DataFrame:
    return evaluate_predictions(df, [key]).where(F.col("n_predictions") >= min_rows)


def metric_distribution(per_station: DataFrame, metric: str = "mae") -> DataFrame:
    """Spread of a per-station metric over the network."""
    spread = exact_quantiles(per_station, [], metric, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    plain = per_station.agg(
        F.avg(metric).alias("mean"), F.max(metric).alias("worst"), F.count(metric).alias("n_stations")
    )
    tails = spread.select(F.struct("median", "p10", "p90")).scalar()
    return plain.withColumn("_t", tails).select("mean", "worst", "n_stations", "_t.*")


def persistence_baseline(df: DataFrame, history: DataFrame, key: str = "sensor_id", time: str = "date", target: str = "pm25"):
    """Value at the same station exactly one day earlier; NULL where that day is missing.

    ``history`` is all labelled data (training and validation); repeated keys take the smallest value.
    """
    before = history.groupBy(key, F.date_add(time, 1).alias(time)).agg(F.min(target).alias("persistence"))
    return df.join(before, [key, time], "left")


def station_month_median(df: DataFrame, key: str = "sensor_id", time: str = "date", target: str = "pm25") -> DataFrame:
    """Median per station and calendar month: at most 31 values per year, so a plain percentile is bounded."""
    return df.groupBy(key, F.month(time).alias("month")).agg(F.percentile(target, 0.5).alias("median"))


def climatology_baseline(df: DataFrame, train: DataFrame, key: str = "sensor_id", time: str = "date", target: str = "pm25"):
    """Training median of (station, month), else of the month, else of everything."""
    own = station_month_median(train, key, time, target).withColumnRenamed("median", "_own")
    # every training row counts for its month and for 0, "all months": at most thirteen medians
    scopes = F.explode(F.array(F.month(time), F.lit(0)))
    medians = exact_quantiles(train.select(target, scopes.alias("scope")), ["scope"], target, {"m": 0.5})
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("scope", "m")))).scalar()
    return (
        df.withColumn("month", F.month(time))
        .join(own, [key, "month"], "left")
        .withColumn("_m", table)
        .withColumn("climatology", F.coalesce("_own", F.try_element_at("_m", F.col("month")), F.try_element_at("_m", F.lit(0))))
        .drop("_own", "_m")
    )


def skill_score(model_error: Column, reference_error: Column) -> Column:
    """One minus the error ratio; NULL without a usable reference."""
    return 1.0 - F.when(reference_error != 0, model_error / reference_error)


def skill_against(df: DataFrame, references: Sequence[str], by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred"):
    """Model error and skill against each reference; every reference is judged on its own known rows."""
    base = [F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"), F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), 2))).alias("rmse")]
    errors = []
    for r in references:
        e = F.col(r) - F.col(y)
        errors += [
            F.avg(F.abs(e)).alias(f"mae_{r}"),
            F.sqrt(F.avg(e * e)).alias(f"rmse_{r}"),
            F.count(e).alias(f"n_{r}"),
        ]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *base, *errors)
    skills = {}
    for r in references:
        skills[f"mae_skill_{r}"] = skill_score(F.col("mae"), F.col(f"mae_{r}"))
        skills[f"rmse_skill_{r}"] = skill_score(F.col("rmse"), F.col(f"rmse_{r}"))
    return out.withColumns(skills)


def common_support_eval(df: DataFrame, predictors: Sequence[str], y: str = "y_true") -> DataFrame:
    """Metrics of several predictors on the rows where all of them exist, one row per predictor."""
    complete = df.na.drop(subset=[y, *predictors])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("_p")) for p in predictors]))
    long = complete.select(F.col(y).alias("_y"), pairs.alias("_m")).select("_y", "_m.*")
    return evaluate_predictions(long, ["model"], "_y", "_p")


def cv_aggregate(folds: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each metric over folds, in long form."""
    long = folds.select(*by, *metrics).unpivot(list(by), list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def with_baselines(test: DataFrame, train: DataFrame, history: DataFrame) -> DataFrame:
    """Test rows with both reference forecasts."""
    return persistence_baseline(climatology_baseline(test, train), history)


