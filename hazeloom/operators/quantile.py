"""Exact, linearly interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one task, which is right for a window of
pixels and wrong for "all rows of a month".  Here ranks are located by two histograms that combine
before their shuffle: one over relative buckets of all rows, one that splits each bucket with a
wanted rank evenly between its own least and greatest value.  Only the rows of the parts that hold a
wanted rank are then shuffled, as distinct values with counts.  The tables of wanted parts, a few rows
per group, are written to the shared folder, so the planner knows their size before it joins them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..semantics import finite
from ..session import stored

BUCKETS_PER_E_FOLD = 1024
PARTS = 4096
#: Of the sketches that bracket a column's quantile, as a share of its values.
SKETCH_ERROR = 1e-4
#: Bins of a column when the medians of many folds are looked for at once.
FOLD_BINS = 1024


def _bucket(v: Column) -> Column:
    """Monotone bucket number with a relative width of about a tenth of a percent."""
    return F.signum(v) * F.floor(F.log1p(F.abs(v) * F.lit(1e6)) * F.lit(BUCKETS_PER_E_FOLD))


def _part(v: Column, low: Column, high: Column) -> Column:
    """Monotone number of an equal part of [low, high]."""
    return F.when(high > low, F.floor((v - low) / (high - low) * F.lit(float(PARTS)))).otherwise(F.lit(0).cast("long"))


def _measures() -> list[Column]:
    return [F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]


def _quantiles(rows: DataFrame, group: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Rows (*group, *probs) from rows (*group, _v, _n)."""
    # the two neighbouring ranks of every probability, as (name, side, rank)
    ranks = ", ".join(
        f"named_struct('name', '{name}', 'side', '{side}', 'rank', CAST({rounding}((_total - 1) * {float(p)!r}D) AS BIGINT))"
        for name, p in probs.items()
        for side, rounding in (("lo", "floor"), ("hi", "ceil"))
    )
    held = "filter({}, w -> w.rank >= _start AND w.rank < _start + _n)"
    rows = rows.withColumn("_b", _bucket(F.col("_v")))
    same = F.expr(" AND ".join(["_b = t_b", *[f"{g} <=> t{g}" for g in group]]))

    by_group = Window.partitionBy(*group)
    first = rows.groupBy(*group, "_b").agg(*_measures())
    first = first.withColumns({"_start": F.sum("_n").over(by_group.orderBy("_b")) - F.col("_n"), "_total": F.sum("_n").over(by_group)})
    first = first.withColumn("_want", F.expr(held.format(f"array({ranks})"))).where("size(_want) > 0")
    first = stored(
        first.select(
            *[F.col(g).alias(f"t{g}") for g in group], F.col("_b").alias("t_b"), F.col("_low").alias("_l"), F.col("_high").alias("_h"),
            F.col("_start").alias("_before"), "_total", "_want",
        ),
        "ranks",
    )

    inside = rows.join(first, same).withColumn("_s", _part(F.col("_v"), F.col("_l"), F.col("_h")))
    once = ["_l", "_h", "_before", "_total", "_want"]
    second = inside.groupBy(*group, "_b", "_s").agg(*_measures(), *[F.first(c).alias(c) for c in once])
    start = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_b").orderBy("_s")) - F.col("_n")
    second = second.withColumn("_start", start).withColumn("_want", F.expr(held.format("_want"))).where("size(_want) > 0")
    second = stored(second, "ranks")

    # parts of one value need no rows; of the others the distinct values are counted
    hits = [*group, "_total", F.expr("explode(_want)").alias("_hit")]
    plain = second.where("_low = _high").select(*hits, F.col("_low").alias("_v"))
    parts = second.where("_low < _high").select(
        *[F.col(g).alias(f"t{g}") for g in group], F.col("_b").alias("t_b"), F.col("_s").alias("t_s"), "_l", "_h", "_start", "_total", "_want"
    )
    values = rows.join(parts, same & (F.col("t_s") == _part(F.col("_v"), F.col("_l"), F.col("_h"))))
    values = values.groupBy(*group, "_b", "t_s", "_v").agg(F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_start", "_total", "_want")])
    stop = F.sum("_n").over(Window.partitionBy(*group, "_b", "t_s").orderBy("_v"))
    values = values.withColumn("_start", F.col("_start") + stop - F.col("_n")).withColumn("_want", F.expr(held.format("_want")))
    found = plain.union(values.select(*hits, "_v")).groupBy(*group)
    found = found.agg(
        F.first("_total").alias("_total"),
        *[
            F.expr(f"max(CASE WHEN _hit.name = '{n}' AND _hit.side = '{s}' THEN _v END)").alias(f"_{s}_{n}")
            for n in probs
            for s in ("lo", "hi")
        ],
    )
    out = [F.col(g) for g in group]
    for n, p in probs.items():
        at = f"(_total - 1) * {float(p)!r}D"
        out.append(F.expr(f"_lo_{n} + (_hi_{n} - _lo_{n}) * ({at} - floor({at}))").alias(n))
    return found.select(*out)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """One row per group with a column per name in ``probs``; NULL, NaN and infinite values are ignored.

    ``weight`` is an integer column saying how many equal values a row stands for.  Groups without any
    value do not appear.  ``keys`` may be empty for a single overall row.  ``df`` is read three times.
    """
    group = [f"_g{i}" for i in range(len(keys))] or ["_g0"]
    named = [F.col(k).alias(g) for k, g in zip(keys, group)] or [F.lit(0).alias("_g0")]
    size = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.select(*named, finite(F.col(value)).alias("_v"), size.alias("_n")).where("_v IS NOT NULL")
    found = _quantiles(rows, group, probs)
    return found.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], *probs)


def _brackets(values: DataFrame, names: Sequence[str], p: float, error: float) -> list[tuple[int, float, float]]:
    """(known values, low, high) of each column: the ranks next to ``p`` lie between low and high, both included."""
    ends = [max(0.0, p - 2 * error), min(1.0, p + 2 * error)]
    sketches = [F.percentile_approx(c, ends, round(1 / error)).alias(c) for c in names]
    row = values.agg(*sketches, *[F.count(c).alias(f"n_{c}") for c in names]).first()
    return [(row[f"n_{c}"], *(row[c] or (0.0, -1.0))) for c in names]


def column_medians(df: DataFrame, columns: Sequence[str], p: float = 0.5) -> DataFrame:
    """Exact interpolated quantile (by default the median) of each column as rows (column, median); columns without a
    value do not appear.

    ``df`` is read twice, its columns side by side. The first pass sketches all columns in one aggregate, which gives
    each a bracket of a few ten-thousandths of its values; it runs when this is called. The second counts in each task
    what lies below each bracket and the values inside it, so only those few are shuffled.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    values = df.select(*[finite(F.col(c)).alias(n) for c, n in zip(columns, names)])
    brackets = _brackets(values, names, p, SKETCH_ERROR) if names else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, (_, low, high) in enumerate(brackets):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                inside, n = np.unique(v[(v >= low) & (v <= high)], return_counts=True)
                # what lies below stands before all values
                inside, n = np.append(-np.inf, inside), np.append((v < low).sum(), n)
                found.append((np.full(len(n), i, np.int32), inside, n))
            parts = [np.concatenate(x) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["i", "v", "n"])

    counted = values.mapInArrow(run, "i int, v double, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n"))
    totals = F.array(*[F.lit(n).cast("long") for n, _, _ in brackets])
    at = (F.get(totals, F.col("i")) - 1) * F.lit(float(p))
    stop = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    placed = counted.withColumns({"_at": at, "_stop": stop}).withColumn("_start", F.col("_stop") - F.col("n"))
    held = lambda rank: F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_stop")), F.col("v")))
    ends = placed.groupBy("i").agg(held(F.floor("_at")).alias("lo"), held(F.ceil("_at")).alias("hi"), F.first("_at").alias("_at"))
    labels = F.array(*[F.lit(c) for c in columns])
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_at") - F.floor("_at"))
    return ends.where("_at >= 0").select(F.get(labels, F.col("i")).alias("column"), middle.alias("median"))


def _edges(values: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Borders of about ``FOLD_BINS`` equally full bins of each column, from one sketch of all of them."""
    at = [i / FOLD_BINS for i in range(1, FOLD_BINS)]
    row = values.agg(*[F.percentile_approx(c, at, 4 * FOLD_BINS).alias(c) for c in names]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in names]


def fold_medians(df: DataFrame, columns: Sequence[str], folds: Sequence[Column], p: float = 0.5) -> DataFrame:
    """Exact interpolated quantile (by default the median) of each column over the rows of each fold, as rows (fold,
    column, median), ``fold`` being the number of its condition; a column without a value in a fold does not appear.

    ``df`` is read three times, whatever the number of folds; the first two run when this is called. The first sketches
    bins of all rows. The second counts each bin's values for every set of folds that rows are in, which tells the bins
    that hold the wanted ranks. The third counts the values in these bins, and only those few are shuffled. The counts
    that come to the driver are as many as columns, bins and sets of folds; folds that overlap in ever new ways are not
    for this.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    within = F.concat(*[F.when(f, "1").otherwise("0") for f in folds]).alias("_in")
    values = df.select(within, *[finite(F.col(c)).alias(n) for c, n in zip(columns, names)])
    edges = _edges(values, names) if names else []
    empty = df.sparkSession.createDataFrame([], "fold int, column string, median double")
    if not names:
        return empty

    def run(batches: Iterator[pa.RecordBatch], wanted: Sequence[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """Counts by column, set of folds and bin, or the values themselves of the wanted bins."""
        for batch in batches:
            sets = batch.column(0).dictionary_encode()
            found = []
            for i, borders in enumerate(edges):
                column = batch.column(i + 1)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                v, group = column.drop_null().to_numpy(zero_copy_only=False), sets.indices.to_numpy()[known]
                at = np.searchsorted(borders, v, side="right")
                if wanted is None:
                    counts = np.bincount(group * (FOLD_BINS + 1) + at)
                    here = counts.nonzero()[0]
                    group, at = np.divmod(here, FOLD_BINS + 1)
                    v, n = np.zeros(len(here)), counts[here]
                else:
                    inside = np.isin(at, wanted[i])
                    v, group, at = v[inside], group[inside], at[inside]
                    n = np.ones(len(v), np.int64)
                found.append((np.full(len(v), i), group, at, v, n))
            i, group, at, v, n = (np.concatenate(x) for x in zip(*found))
            kinds = [pa.array(x, t) for x, t in ((i, pa.int32()), (at, pa.int32()), (v, pa.float64()), (n, pa.int64()))]
            parts = [kinds[0], sets.dictionary.take(pa.array(group, pa.int64())), *kinds[1:]]
            yield pa.RecordBatch.from_arrays(parts, ["i", "sets", "bin", "v", "n"])

    schema = "i int, sets string, bin int, v double, n bigint"
    counted = values.mapInArrow(lambda batches: run(batches, None), schema).groupBy("i", "sets", "bin").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(names), len(folds), FOLD_BINS + 1), np.int64)
    for r in counted.collect():
        counts[r.i, [f for f, held in enumerate(r.sets) if held == "1"], r.bin] += r.n

    targets, wanted = [], [set() for _ in names]
    for i in range(len(names)):
        for f in range(len(folds)):
            stop = counts[i, f].cumsum()
            if stop[-1] == 0:
                continue
            at = (int(stop[-1]) - 1) * p
            for rank in {math.floor(at), math.ceil(at)}:
                b = int(np.searchsorted(stop, rank, side="right"))
                wanted[i].add(b)
                targets.append((i, b, f, int(stop[b] - counts[i, f, b]), rank, at))
    if not targets:
        return empty
    picked = [np.array(sorted(w), int) for w in wanted]
    inside = values.mapInArrow(lambda batches: run(batches, picked), schema).groupBy("i", "sets", "bin", "v").agg(F.sum("n").alias("n"))
    # at most two rows per column and fold
    table = df.sparkSession.createDataFrame(targets, "i int, bin int, fold int, before long, rank long, at double")
    held = inside.join(F.broadcast(table), ["i", "bin"]).where(F.substring("sets", F.col("fold") + 1, F.lit(1)) == "1")
    held = held.groupBy("fold", "i", "rank", "v").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("before", "at")])
    stop = F.sum("n").over(Window.partitionBy("fold", "i", "rank").orderBy("v")) + F.col("before")
    hit = held.withColumn("_stop", stop).where("_stop - n <= rank AND rank < _stop")
    ends = hit.groupBy("fold", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("at").alias("_at"))
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("_at") - F.floor("_at"))
    return ends.select("fold", F.get(F.array(*[F.lit(c) for c in columns]), F.col("i")).alias("column"), middle.alias("median"))


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Interpolated quantile of a small sorted array (a window of pixels); NULL if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.get(ordered, F.floor(at).cast("int"))
    high = F.get(ordered, F.ceil(at).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


def array_median(values: Column) -> Column:
    return sorted_quantile(F.sort_array(values), 0.5)
