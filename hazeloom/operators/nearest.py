"""Nearest cell of every point by a best-first search over buckets that adapt to density.

Cells are bucketed once, into a tree of squares: a square with more than ``LEAF`` cells is split in four, so crowded
areas have small leaves and empty ones have none. All places go down the tree together, a level a step. A place keeps
the squares that may still hold its nearest cell: those whose tight box is no farther than the nearest point by which
some other box surely has a cell (each side of a tight box touches one). So a place near cells and one an ocean away
both end in a few leaves, whatever the distance, and only the cells of these are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

LEAF = 32
#: Levels below those that evenly spread cells would need.
EXTRA_LEVELS, MOST_LEVELS = 2, 24

# squared distance from (y, x) to the box (y1, y2, x1, x2), and to the farthest of the nearest points by which it has a cell
_LEAST = "pow(greatest(y1 - y, y - y2, 0D), 2) + pow(greatest(x1 - x, x - x2, 0D), 2)"
_NEAR = "pow({p} - IF({p} <= ({p}1 + {p}2) / 2, {p}1, {p}2), 2)"
_FAR = "pow({p} - IF({p} >= ({p}1 + {p}2) / 2, {p}1, {p}2), 2)"
_SURE = f"least({_NEAR.format(p='y')} + {_FAR.format(p='x')}, {_FAR.format(p='y')} + {_NEAR.format(p='x')})"


def _tree(cells: DataFrame, depth: int, low: tuple[float, float], span: float) -> tuple[DataFrame, DataFrame]:
    """Squares (depth, u, v, n, y1, y2, x1, x2) of all depths, and the cells with their leaf (depth, u, v)."""
    top = 2**depth
    place = lambda c, start: f"CAST(least(floor(({c} - {start!r}D) / {span!r}D * {top}D), {top - 1}) AS BIGINT)"
    at = cells.selectExpr("*", f"{place('y', low[0])} AS _u", f"{place('x', low[1])} AS _v")
    at = at.selectExpr("*", f"explode(sequence(0, {depth})) AS depth")
    at = at.selectExpr("* EXCEPT (_u, _v)", f"shiftright(_u, {depth} - depth) AS u", f"shiftright(_v, {depth} - depth) AS v")
    squares = at.groupBy("depth", "u", "v").agg(
        F.count("*").alias("n"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2")
    )
    squares = stored(squares, "squares")
    small = squares.where(f"n <= {LEAF} OR depth = {depth}").select("depth", "u", "v")
    # a cell's leaf is the largest square that is not split
    leaf = at.join(small, ["depth", "u", "v"]).groupBy("cell_lat", "cell_lon", "y", "x").agg(F.min(F.struct("depth", "u", "v")).alias("at"))
    return squares, leaf.select("cell_lat", "cell_lon", F.col("y").alias("cy"), F.col("x").alias("cx"), "at.*")


def nearest_cells(places: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (_y, _x, cell_lat, cell_lon): the nearest cell of each place (_y, _x), in latitude and scaled longitude.

    Longitudes are scaled by the cosine of the cells' median latitude. Distances that agree to twelve decimals tie, and
    the southern, then western cell wins. Places without coordinates get no row, and none do if there are no cells;
    cells without coordinates or given several times count once or not at all.
    """
    cells = cells.select("cell_lat", "cell_lon").where("cell_lat + cell_lon IS NOT NULL AND NOT isnan(cell_lat + cell_lon)").distinct()
    cells = stored(cells, "cells")
    bounds = [f(c) for c in ("cell_lat", "cell_lon") for f in (F.min, F.max)]
    middle, n, y1, y2, x1, x2 = cells.agg(F.percentile("cell_lat", 0.5), F.count("*"), *bounds).first()
    scale = max(math.cos(math.radians(middle or 0.0)), 1e-3)
    known = places.where("_y + _x IS NOT NULL AND NOT isnan(_y + _x)").select("_y", "_x").distinct()
    if not n:
        return known.where("false").select("*", F.lit(None).cast("double").alias("cell_lat"), F.lit(None).cast("double").alias("cell_lon"))
    cells = cells.selectExpr("*", "cell_lat AS y", f"cell_lon * {scale!r}D AS x")
    x1, x2 = x1 * scale, x2 * scale
    depth = min(MOST_LEVELS, max(0, math.ceil(math.log(n / LEAF, 4))) + EXTRA_LEVELS)
    squares, leaves = _tree(cells, depth, (y1, x1), max(y2 - y1, x2 - x1) or 1.0)

    # squares that stay are at depth d; leaves have d replaced by -1 - d, so they meet no children
    done = -1 if n <= LEAF else 0
    state = known.selectExpr("_y", "_x", "_y AS y", f"_x * {scale!r}D AS x", f"{done} AS depth", "0L AS u", "0L AS v", "0D AS least", "CAST('Infinity' AS DOUBLE) AS sure")
    by_place = Window.partitionBy("_y", "_x")
    for d in range(1, depth + 1 if done == 0 else 1):
        kids = squares.where(F.col("depth") == d).selectExpr(
            f"{d - 1} AS depth", "shiftright(u, 1) AS u", "shiftright(v, 1) AS v", "u AS ku", "v AS kv",
            f"IF(n <= {LEAF} OR {d} = {depth}, {-1 - d}, {d}) AS kd", "y1", "y2", "x1", "x2",
        )
        state = (
            state.join(kids, ["depth", "u", "v"], "left")
            .selectExpr(
                "_y", "_x", "y", "x", "coalesce(kd, depth) AS depth", "coalesce(ku, u) AS u", "coalesce(kv, v) AS v",
                f"IF(kd IS NULL, least, {_LEAST}) AS least", f"IF(kd IS NULL, sure, {_SURE}) AS sure",
            )
            .withColumn("_bound", F.min("sure").over(by_place))
            .where("least <= _bound * (1 + 1e-9) + 1e-11")
            .drop("_bound")
        )
    state = state.selectExpr("_y", "_x", "y", "x", "-1 - depth AS depth", "u", "v")
    near = state.join(leaves, ["depth", "u", "v"])
    best = "min(struct(round(pow(cy - y, 2) + pow(cx - x, 2), 12) AS d2, cell_lat, cell_lon))"
    return near.groupBy("_y", "_x").agg(F.expr(best).alias("_hit")).select("_y", "_x", "_hit.cell_lat", "_hit.cell_lon")
