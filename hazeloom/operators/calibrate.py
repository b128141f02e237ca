"""Daily calibration of predictions against anchor stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .quantile import exact_quantiles


def daily_offset_fit(anchors: DataFrame, date: str = "date", y: str = "y_true", p: str = "y_pred", min_rows: int = 3) -> DataFrame:
    """Median residual of each day with enough anchors, else zero."""
    residual = anchors.select(date, (F.col(y) - F.col(p)).alias("_r"))
    n = residual.groupBy(date).agg(F.count("_r").alias("n"))
    median = exact_quantiles(residual, [date], "_r", {"_m": 0.5})
    return n.join(median, date, "left").select(
        date, "n", F.when(F.col("n") >= min_rows, F.col("_m")).otherwise(0.0).alias("day_offset")
    )


def daily_offset_apply(df: DataFrame, offsets: DataFrame, date: str = "date", p: str = "y_pred", out: str = "calibrated"):
    joined = df.join(offsets.select(date, "day_offset"), date, "left")
    return joined.withColumn(out, F.col(p) + F.coalesce("day_offset", F.lit(0.0))).drop("day_offset")


def daily_line_fit(anchors: DataFrame, date: str = "date", y: str = "y_true", p: str = "y_pred", min_rows: int = 5) -> DataFrame:
    """Plain least-squares line per day; identity where the day has too few anchors or no spread."""
    enough = F.count(F.lit(1)) >= min_rows
    slope, intercept = F.regr_slope(y, p), F.regr_intercept(y, p)
    usable = enough & slope.isNotNull()
    return anchors.groupBy(date).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(usable, slope).otherwise(1.0).alias("slope"),
        F.when(usable, intercept).otherwise(0.0).alias("intercept"),
    )


def _huber_step(rows: DataFrame, params: DataFrame, date: str, epsilon: float) -> DataFrame:
    """Line and scale per day from the moments that the current ones weigh; ``rows`` are (date, _x, _y, _n)."""
    r = F.abs(F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept"))
    bound = F.col("scale") * epsilon
    outlier = r > bound
    w = F.col("_n") * F.when(outlier, bound / r).otherwise(1.0)
    weighed = rows.join(params.drop("n"), date).withColumns({"_w": w, "_out": F.when(outlier, F.col("_n")).otherwise(0), "_r": r})
    moments = weighed.groupBy(date).agg(
        F.sum("_w").alias("sw"),
        F.sum(F.col("_w") * F.col("_x")).alias("sx"),
        F.sum(F.col("_w") * F.col("_y")).alias("sy"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("sxx"),
        F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("sxy"),
        F.sum(F.when(F.col("_out") == 0, F.col("_n") * F.col("_r") * F.col("_r")).otherwise(0.0)).alias("inlier_r2"),
        F.sum("_out").alias("outliers"),
        F.sum("_n").alias("n"),
        F.first("slope").alias("_slope"),
        F.first("intercept").alias("_intercept"),
    )
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(det, F.lit(0.0))
    left = F.greatest(F.col("n") - F.col("outliers") * epsilon**2, F.lit(1.0))
    return moments.withColumn("slope", slope).select(
        date,
        "slope",
        ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"),
        F.greatest(F.sqrt(F.col("inlier_r2") / left), F.lit(1e-9)).alias("scale"),
        "n",
        "_slope",
        "_intercept",
    )


def daily_affine_fit(
    anchors: DataFrame,
    date: str = "date",
    y: str = "y_true",
    p: str = "y_pred",
    min_rows: int = 5,
    epsilon: float = 1.35,
    most: int = 60,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Robust (Huber) line per day, identity for days with fewer anchors than ``min_rows``.

    All days are fitted together: every step reweights the rows with the day's current line and scale and sums the
    weighted moments per day, which combines map-side, so the number of anchors of a day does not matter.  The
    anchors are read once, as counted pairs, and stored; the steps go on until no line moves by more than
    ``tolerance`` of its size, which is asked every fifth step, and ``most`` steps in any case; ``converged`` tells the
    days whose line has come to rest from those that still moved then.
    The scale follows from the joint Huber objective: squared residuals of the inliers over
    ``n - n_outliers * epsilon^2``.
    """
    rows = anchors.select(date, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_x"))
    rows = rows.where(F.col("_y").isNotNull() & F.col("_x").isNotNull()).groupBy(date, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    rows = stored(rows, "anchors")
    x, v, n = F.col("_x"), F.col("_y"), F.col("_n")
    first = rows.groupBy(date).agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * v).alias("sy"), F.sum(n * x * x).alias("sxx"),
        F.sum(n * x * v).alias("sxy"), F.sum(n * v * v).alias("syy"),
    )
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2), F.lit(0.0)))
    params = first.withColumn("slope", slope).select(
        date, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), spread.alias("scale"), "n"
    )
    for _ in range(0, most, 5):
        for _ in range(5):
            params = _huber_step(rows, params.select(date, "slope", "intercept", "scale", "n"), date, epsilon)
        params = stored(params, "lines")
        moved = F.greatest(
            *[F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0)) for c in ("slope", "intercept")]
        )
        if not (params.agg(F.max(moved)).first()[0] or 0.0) > tolerance:
            break
    still = F.coalesce(moved <= tolerance, F.lit(True))
    usable = (F.col("n") >= min_rows) & F.col("slope").isNotNull()
    return params.select(
        date,
        "n",
        F.when(usable, F.col("slope")).otherwise(1.0).alias("slope"),
        F.when(usable, F.col("intercept")).otherwise(0.0).alias("intercept"),
        (~usable | still).alias("converged"),
    )


def daily_affine_apply(df: DataFrame, lines: DataFrame, date: str = "date", p: str = "y_pred", out: str = "calibrated"):
    """Apply each day's line; a day without one keeps its predictions."""
    joined = df.join(lines.select(date, "slope", "intercept"), date, "left")
    value = F.coalesce("slope", F.lit(1.0)) * F.col(p) + F.coalesce("intercept", F.lit(0.0))
    return joined.withColumn(out, value).drop("slope", "intercept")
