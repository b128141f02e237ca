"""Statistics of the pixels around a point: windows, scales, quality and file merging.

A window is at most (2r+1)^2 pixels of one raster, so exact percentiles and small arrays per window
are bounded by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import AOD_VALID_RANGE, MIN_VALID_PIXELS
from ..functions.quality import in_range_or_null, mode_in_range, qa_bits, qa_filter, qa_pass
from .quantile import array_median, sorted_quantile
from .summed import summed_area, window_sums


def window_offsets(points: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Every in-bounds pixel address around each point, with its ring number."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return (
        points.withColumn("_dr", F.explode(steps))
        .withColumn("_dc", F.explode(steps))
        .withColumns(
            {
                "row": F.col("prow") + F.col("_dr"),
                "col": F.col("pcol") + F.col("_dc"),
                "ring": F.greatest(F.abs("_dr"), F.abs("_dc")),
            }
        )
        .where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
        .drop("_dr", "_dc")
    )


def pixel_window_join(
    points: DataFrame, pixels: DataFrame, radius: int, height: int, width: int, equal: Sequence[str] = ()
) -> DataFrame:
    """Pixels within ``radius`` rows and columns of each point, cut at the raster edge.

    Offsets are exploded on the point side; the pixel table is scanned once and joined on its address
    (plus ``equal`` columns such as the tile).
    """
    near = window_offsets(points, radius, height, width)
    return near.join(pixels.withColumnsRenamed({"prow": "row", "pcol": "col"}), [*equal, "row", "col"])


def at_addresses(points: DataFrame, compute: Callable[[DataFrame], DataFrame], equal: Sequence[str] = ()) -> DataFrame:
    """Window results per point, computed once per distinct pixel address.

    A window depends on the address alone, and there are at most as many addresses as the raster has
    pixels, however many points share them.  ``compute`` maps addresses (prow, pcol, equal columns) to
    rows that keep those columns.
    """
    address = ["prow", "pcol", *equal]
    return points.join(compute(points.select(*address).distinct()), address)


def _deviation_or(default: float, std: Column, moment: Column, n: Column, least: int) -> Column:
    return F.when(n < least, None).when(std <= 1e-12, F.lit(default)).otherwise(moment)


def robust_window_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median to kurtosis of each pixel set; all NULL without a valid pixel."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n_pixels"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("_skew"),
        F.kurtosis(v).alias("_kurt"),
        F.sort_array(F.collect_list(v)).alias("_all"),
    )
    quantiles = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    n, std = F.col("n_pixels"), F.col("std")
    deviations = F.transform("_all", lambda x: F.abs(x - F.col("median")))
    return base.withColumns({name: sorted_quantile(F.col("_all"), p) for name, p in quantiles.items()}).withColumns(
        {
            "iqr": F.col("p75") - F.col("p25"),
            "mad": array_median(deviations),
            "range": F.col("max") - F.col("min"),
            "cv": std / (F.abs("mean") + 1e-12),
            "skew": _deviation_or(0.0, std, F.col("_skew"), n, 3),
            "kurt": _deviation_or(0.0, std, F.col("_kurt"), n, 4),
        }
    ).drop("_all", "_skew", "_kurt")


SCALES = ("r05", "r1", "r2")


def scale_radii(radius_km: float, per_km: float) -> list[int]:
    """Pixel radii for half, one and two times the radius; at least one pixel."""
    return [max(1, round(radius_km * f * per_km)) for f in (0.5, 1.0, 2.0)]


def window_size(radius: int, height: int, width: int) -> Column:
    """Number of raster pixels inside the window around (prow, pcol), cut at the edges."""

    def span(axis: str, n: int) -> Column:
        return F.least(F.lit(n - 1), F.col(axis) + radius) - F.greatest(F.lit(0), F.col(axis) - radius) + 1

    return span("prow", height) * span("pcol", width)


def multiscale_stats(
    df: DataFrame,
    keys: Sequence[str],
    radii: Sequence[int],
    shape: tuple[int, int] | None = None,
    value: str = "value",
    qa: str = "qa",
) -> DataFrame:
    """Counts, coverage, median and std at three nested radii from one read at the largest.

    Coverage and quality shares refer to the pixels of the window: by geometry when the raster's
    ``shape`` is given (missing pixels then count as invalid), else to the rows present.
    """
    good = qa_filter(F.col(value), F.col(qa))
    aggregates = []
    for suffix, radius in zip(SCALES, radii):
        inside = F.col("ring") <= radius
        v = F.when(inside, good)
        total = F.count(F.when(inside, F.lit(1))) if shape is None else F.max(window_size(radius, *shape))
        passed = F.count(F.when(inside & qa_pass(F.col(qa)), F.lit(1)))
        aggregates += [
            F.count(v).alias(f"n_pixels_{suffix}"),
            F.coalesce(F.try_divide(F.count(v), total), F.lit(0.0)).alias(f"window_coverage_{suffix}"),
            F.coalesce(F.try_divide(passed, total), F.lit(0.0)).alias(f"qa_pass_fraction_{suffix}"),
            F.collect_list(v).alias(f"median_{suffix}"),
            F.stddev_pop(v).alias(f"std_{suffix}"),
        ]
    out = df.groupBy(*keys).agg(*aggregates)
    return out.withColumns({f"median_{s}": array_median(F.col(f"median_{s}")) for s in SCALES})


def best_scale(df: DataFrame, min_pixels: int = MIN_VALID_PIXELS) -> DataFrame:
    """First scale with enough pixels, else the one with most (smallest radius on ties), else none."""
    counts = {s: F.col(f"n_pixels_{s}") for s in SCALES}
    top = F.greatest(*counts.values())
    choice = F.lit(None).cast("string")
    for s in reversed(SCALES):
        choice = F.when((counts[s] == top) & (top > 0), s).otherwise(choice)
    for s in reversed(SCALES):
        choice = F.when(counts[s] >= min_pixels, s).otherwise(choice)
    reason = F.when(F.col("best_scale").isNull(), "no_valid_pixels_after_masking").otherwise("")
    return df.withColumn("best_scale", choice).withColumn("invalid_reason", reason)


def pick_scale(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns of the chosen scale under their plain names."""

    def chosen(name: str) -> Column:
        out = F.lit(None)
        for s in SCALES:
            out = F.when(F.col("best_scale") == s, F.col(f"{name}_{s}")).otherwise(out)
        return out

    return df.withColumns({n: chosen(n) for n in names})


def scale_deltas(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "delta_median_r1_r05": F.col("median_r1") - F.col("median_r05"),
            "delta_median_r2_r1": F.col("median_r2") - F.col("median_r1"),
            "delta_std_r2_r05": F.col("std_r2") - F.col("std_r05"),
        }
    )


def best_scale_stats(joined: DataFrame, keys: Sequence[str], radii: Sequence[int], value="value", qa="qa") -> DataFrame:
    """Full statistics at the best scale only: cheap counts pick the scale before costly percentiles run."""
    w = Window.partitionBy(*keys)
    good = qa_filter(F.col(value), F.col(qa))
    counted = joined.withColumn("_good", good).withColumns(
        {f"n_pixels_{s}": F.count(F.when(F.col("ring") <= r, F.col("_good"))).over(w) for s, r in zip(SCALES, radii)}
    )
    limit = F.lit(None).cast("int")
    for s, r in zip(SCALES, radii):
        limit = F.when(F.col("best_scale") == s, r).otherwise(limit)
    kept = best_scale(counted).where(F.col("ring") <= limit)
    return robust_window_stats(kept, [*keys, "best_scale"], "_good")


def progressive_window(joined: DataFrame, keys: Sequence[str], layers: Sequence[str], qa: str = "qa") -> DataFrame:
    """Smallest of the 3/5/7 windows with any valid layer value, per point and file; its medians and QA modes.

    A file without a valid pixel in the largest window keeps its row: no size, no values, zero counts.
    """
    masked = joined.withColumns({c: in_range_or_null(F.col(c), *AOD_VALID_RANGE) for c in layers})
    any_valid = F.coalesce(*[F.col(c) for c in layers]).isNotNull()
    ring = F.min(F.when(any_valid, F.greatest(F.col("ring"), F.lit(1)))).over(Window.partitionBy(*keys))
    limited = masked.withColumn("_limit", ring)
    inside = F.col("ring") <= F.col("_limit")
    limited = limited.withColumns({c: F.when(inside, F.col(c)) for c in [*layers, qa]})
    top = {"qa_cloudmask": 7, "qa_adjacency": 7, "qa_aod": 15}
    return (
        limited.withColumns(qa_bits(F.col(qa)))
        .groupBy(*keys)
        .agg(
            *[F.percentile(c, 0.5).alias(c) for c in layers],
            *[F.count(c).alias(f"{c}_n_pixels") for c in layers],
            *[mode_in_range(F.col(n), m).alias(n) for n, m in top.items()],
            F.count(qa).alias("qa_n_pixels"),
            (F.first("_limit") * 2 + 1).alias("window_size_used"),
        )
    )


def aod_across_files(per_file: DataFrame, keys: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """One row per point and day: medians over the files that contributed, QA modes, pixel totals."""
    pixels = sum((F.coalesce(F.col(f"{c}_n_pixels"), F.lit(0)) for c in layers), F.lit(0))
    return per_file.groupBy(*keys).agg(
        *[F.percentile(c, 0.5).alias(c) for c in layers],
        *[F.mode(c, deterministic=True).alias(c) for c in ("qa_cloudmask", "qa_adjacency", "qa_aod")],
        F.sum("qa_n_pixels").alias("qa_n_pixels"),
        F.sum(pixels).alias("aod_total_valid_pixels"),
        F.percentile("window_size_used", 0.5).alias("aod_window_size_used"),
        F.count("window_size_used").alias("aod_files_used"),
        F.count(F.lit(1)).alias("aod_n_files"),
    )


def daily_pixel_mean(pixels: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(value).alias(value))


def raster_decimate(pixels: DataFrame, factor: int, keys: Sequence[str], nodata: float | None = None, value="value") -> DataFrame:
    """Block averages; missing pixels do not count."""
    v = F.col(value) if nodata is None else F.when(F.col(value) != nodata, F.col(value))
    return pixels.groupBy(
        *keys,
        F.floor(F.col("prow") / factor).cast("int").alias("brow"),
        F.floor(F.col("pcol") / factor).cast("int").alias("bcol"),
    ).agg(F.avg(v).alias(value))


def grid_window_stat(
    grid: DataFrame, keys: Sequence[str], radius: int, stat: str, height: int, width: int, value: str = "value"
) -> DataFrame:
    """Statistic of the (2r+1)^2 window of each cell with the border replicated outwards; works for any key columns.

    ``sum``, ``count`` and ``mean`` are differences of a summed-area table, whatever the radius. ``max``, ``min`` and
    ``std`` are not; there each cell is sent to the windows that read it, a border cell once per replicated copy.
    """
    if stat in ("sum", "count", "mean"):
        sums = window_sums(summed_area(grid, keys, height, width, value), grid, keys, radius, height, width, replicate=True)
        found = {"sum": F.col("total"), "count": F.col("n"), "mean": F.col("total") / F.col("n")}[stat]
        return sums.select(*keys, "prow", "pcol", F.when(F.col("n") > 0, found).alias(value) if stat != "count" else found.alias(value))
    aggregate = {"max": F.max, "min": F.min, "std": F.stddev_pop}[stat]
    steps = F.sequence(F.lit(-radius), F.lit(radius))

    def clamp(c: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), c))

    addresses = (
        grid.select(*keys, "prow", "pcol")
        .withColumn("_dr", F.explode(steps))
        .withColumn("_dc", F.explode(steps))
        .select(
            *keys,
            "prow",
            "pcol",
            clamp(F.col("prow") + F.col("_dr"), height).alias("_r"),
            clamp(F.col("pcol") + F.col("_dc"), width).alias("_c"),
        )
    )
    source = grid.select(*keys, F.col("prow").alias("_r"), F.col("pcol").alias("_c"), F.col(value).alias("_v"))
    return addresses.join(source, [*keys, "_r", "_c"], "left").groupBy(*keys, "prow", "pcol").agg(aggregate("_v").alias(value))
