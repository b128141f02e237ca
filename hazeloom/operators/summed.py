"""Summed-area tables: window sums, counts and means of any radius from four lookups.

A raster is cut into blocks of ``BLOCK`` x ``BLOCK`` cells. Each block is summed by itself, along rows and then along
columns; its last row and last column are carried over to the blocks below and to the right as running sums, which are
the only windows and hold one number per block. The sum of all cells up to row i and column j is then the block's own
number, plus what is carried from above, from the left, and from above left. A window is the difference of four such
sums, so neither time nor shuffle depends on its radius, and a large raster is as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.window import Window

from ..semantics import finite

BLOCK = 64
MEASURES = ("total", "n")


def _summed_blocks(height: int, width: int, keys: Sequence[str]):
    def run(group: pa.Table) -> pa.Table:
        cells = np.zeros((len(MEASURES), height, width))
        at = group.column("_i").to_numpy(), group.column("_j").to_numpy()
        value = group.column("_v").to_numpy()
        known = ~np.isnan(value)  # an empty cell comes as NaN
        for m, part in enumerate((np.where(known, value, 0.0), known.astype(float))):
            np.add.at(cells[m], at, part)
        sums = cells.cumsum(axis=1).cumsum(axis=2)
        arrays = [group.column(c).slice(0, 1) for c in (*keys, "_bi", "_bj")]
        for part in (sums.reshape(len(MEASURES), -1), sums[:, -1, :], sums[:, :, -1]):
            arrays += [pa.array([p.tolist()], pa.list_(pa.float64())) for p in part]
        names = [f"{kind}_{m}" for kind in ("own", "down", "right") for m in MEASURES]
        return pa.table(arrays, [*keys, "_bi", "_bj", *names])

    return run


def summed_area(grid: DataFrame, keys: Sequence[str], height: int, width: int, value: str = "value", row="prow", col="pcol") -> DataFrame:
    """One row per raster and block: (*keys, _bi, _bj) and, for total and n, the arrays own, above, left and number corner.

    Cells that are missing, null or not finite add nothing; cells given several times add up. Cells outside the raster
    are left out. Every block of a raster has a row, also one without cells.
    """
    h, w = min(BLOCK, height), min(BLOCK, width)
    rows, cols = -(-height // h), -(-width // w)
    inside = grid.where(F.col(row).between(0, height - 1) & F.col(col).between(0, width - 1))
    cells = inside.select(
        *keys, F.floor(F.col(row) / h).cast("int").alias("_bi"), F.floor(F.col(col) / w).cast("int").alias("_bj"),
        (F.col(row) % h).cast("int").alias("_i"), (F.col(col) % w).cast("int").alias("_j"), finite(F.col(value)).alias("_v"),
    )
    # of a raster's blocks those without cells get one empty cell
    each = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("_b")
    empty = inside.select(*keys).distinct().select(*keys, each).selectExpr(
        *[f"`{k}`" for k in keys], f"CAST(_b DIV {cols} AS INT) AS _bi", f"CAST(_b % {cols} AS INT) AS _bj", "0 AS _i", "0 AS _j", "CAST(NULL AS DOUBLE) AS _v"
    )
    schema = StructType([cells.schema[k] for k in keys]).add("_bi", IntegerType()).add("_bj", IntegerType())
    for kind in ("own", "down", "right"):
        for m in MEASURES:
            schema = schema.add(f"{kind}_{m}", ArrayType(DoubleType()))
    blocks = cells.union(empty).groupBy(*keys, "_bi", "_bj").applyInArrow(_summed_blocks(h, w, keys), schema)

    # running sums of last rows down the blocks, of last columns to the right, and of what came down to the right
    side = max(h, w)
    edges = blocks.select(*keys, "_bi", "_bj", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("_at"), *[f"{k}_{m}" for k in ("down", "right") for m in MEASURES])
    before = lambda axis, fixed: Window.partitionBy(*keys, fixed, "_at").orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0.0))
    edges = edges.withColumns({f"above_{m}": carried(F.get(f"down_{m}", F.col("_at")), before("_bi", "_bj")) for m in MEASURES})
    edges = edges.withColumns(
        {f"left_{m}": carried(F.get(f"right_{m}", F.col("_at")), before("_bj", "_bi")) for m in MEASURES}
        | {f"corner_{m}": carried(F.col(f"above_{m}"), before("_bj", "_bi")) for m in MEASURES}
    )
    parts = [f"{k}_{m}" for k in ("above", "left", "corner") for m in MEASURES]
    line = F.sort_array(F.collect_list(F.struct("_at", *parts))).alias("_line")
    edges = edges.groupBy(*keys, "_bi", "_bj").agg(line)
    edges = edges.select(
        *keys, "_bi", "_bj", *[F.col("_line")[p].alias(p) for p in parts if not p.startswith("corner")],
        *[F.get(F.col("_line")[f"corner_{m}"], F.lit(w - 1)).alias(f"corner_{m}") for m in MEASURES],
    )
    own = blocks.select(*keys, "_bi", "_bj", *[f"own_{m}" for m in MEASURES])
    same = [own[k].eqNullSafe(edges[k]) for k in keys] + [own[b] == edges[b] for b in ("_bi", "_bj")]
    return own.join(edges, same).select(*[own[c] for c in own.columns], *[c for c in edges.columns if c not in (*keys, "_bi", "_bj")])


def _nodes(index: str, radius: int, size: int, replicate: bool) -> str:
    """Array of (node, factor) along an axis whose weighted running sums make the window's sum.

    The window is the running sum up to index + radius less that up to index - radius - 1. Past the border it stays what
    it is, or, with the border replicated outwards, goes on in a straight line.
    """

    def at(a: str, sign: str) -> str:
        if not replicate:
            return f"array(named_struct('node', least({a}, {size - 1}), 'factor', {sign}1))"
        over = f"({a} - {size - 1})"
        return f"""CASE WHEN {a} >= {size} THEN array(named_struct('node', {size - 1}, 'factor', {sign}(1 + {over})),
                named_struct('node', {size - 2}, 'factor', {sign}(-{over})))
            WHEN {a} < -1 THEN array(named_struct('node', 0, 'factor', {sign}({a} + 1)))
            ELSE array(named_struct('node', {a}, 'factor', {sign}1)) END"""

    return f"concat({at(f'({index} + {radius})', '')}, {at(f'({index} - {radius + 1})', '-')})"


def window_sums(
    table: DataFrame, targets: DataFrame, keys: Sequence[str], radius: int, height: int, width: int, replicate: bool = False, row="prow", col="pcol"
) -> DataFrame:
    """Rows (*keys, row, col, total, n) for each distinct target cell: sum and number of the values in its window of
    (2 radius + 1)^2 cells, cut at the border, or with border cells repeated outwards.

    ``table`` is what ``summed_area`` made, of the same height and width. A window without a value has a null total.
    """
    h, w = min(BLOCK, height), min(BLOCK, width)
    cell = [*keys, row, col]
    rows, cols = _nodes(f"CAST(`{row}` AS INT)", radius, height, replicate), _nodes(f"CAST(`{col}` AS INT)", radius, width, replicate)
    pairs = f"""flatten(transform({rows}, r -> transform({cols}, c -> named_struct('i', r.node, 'j', c.node, 'factor', r.factor * c.factor))))"""
    wanted = targets.select(*cell).distinct().withColumn("_x", F.explode(F.expr(f"filter({pairs}, x -> x.i >= 0 AND x.j >= 0 AND x.factor <> 0)")))
    wanted = wanted.select(*cell, F.expr(f"_x.i DIV {h}").cast("int").alias("_bi"), F.expr(f"_x.j DIV {w}").cast("int").alias("_bj"), F.expr(f"_x.i % {h}").alias("_i"), F.expr(f"_x.j % {w}").alias("_j"), "_x.factor")
    same = [wanted[k].eqNullSafe(table[k]) for k in keys] + [wanted[b] == table[b] for b in ("_bi", "_bj")]
    met = wanted.join(table, same).select(*[wanted[c] for c in wanted.columns], *[c for c in table.columns if c not in (*keys, "_bi", "_bj")])
    upto = lambda m: F.expr(f"factor * (own_{m}[_i * {w} + _j] + above_{m}[_j] + left_{m}[_i] + corner_{m})")
    found = met.groupBy(*cell).agg(*[F.sum(upto(m)).alias(m) for m in MEASURES])
    n = F.round("n").cast("long")
    return found.select(*cell, F.when(n > 0, F.col("total")).alias("total"), n.alias("n"))
