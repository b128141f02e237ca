"""Cell cover of polygons: which cells of a latitude-longitude lattice lie inside, and which hold a piece of border.

Rows of cells are ``CELL`` degrees high. An edge touches a few cells of each row it passes; those are boundary cells
and keep the edges that touch them, no others. Between two boundary cells of a row no edge passes, so the whole gap is
inside or outside, by the parity of the crossings east of it; gaps inside are covered by cells of one row and 1, 2, 4,
... columns. A point looks up its row and the cells of every width that hold it: an equi-join. An inside cell settles
it; in a boundary cell the parity east of the cell is known, so only the cell's own edges are crossed.

``CELL`` is a power of two, so that cell borders are exact numbers and every test below compares the same way as one
ray from the point through all edges would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 0.125
#: Widest inside cell: 2 ** WIDEST columns, 64 degrees.
WIDEST = 9
BORDER = -1
#: Added around an edge's piece of a row, far more than its rounding; a cell too many does no harm.
SLACK = 1e-9

# expressions over an edge ``e`` with x1, y1, x2, y2
#: Longitude of the edge at a latitude; null for level edges, which cross no level line.
AT = "(e.x1 + (e.x2 - e.x1) * ({y} - e.y1) / nullif(e.y2 - e.y1, 0D))"
STRADDLES = "((e.y1 > {y}) <> (e.y2 > {y}))"
#: Whether an edge that crosses the meridian ``x`` does so below ``y``.
BELOW = f"""(CASE WHEN {STRADDLES} THEN ({AT} > {{x}}) = (IF(e.y1 > e.y2, e.x1, e.x2) > {{x}}) ELSE e.y1 <= {{y}} END)"""
MIDDLE, SIDE = f"((row + 0.5D) * {CELL}D)", f"((cell + 1) * {CELL}D)"


def _inside_cells() -> str:
    """The columns a .. b of a row as an array of cells: whole cells of level k are first .. last, and those that level
    k + 1 does not cover are the outermost."""
    first = lambda k: f"shiftright(a + shiftleft(1L, {k}) - 1, {k})"
    last = lambda k: f"(shiftright(b + 1, {k}) - 1)"
    outermost = f"""filter(array(IF({first('k')} < 2 * {first('k + 1')}, {first('k')}, NULL),
        IF({last('k')} > 2 * {last('k + 1')} + 1, {last('k')}, NULL)), c -> c IS NOT NULL)"""
    at_level = f"""CASE WHEN k < {WIDEST} AND {first('k + 1')} <= {last('k + 1')} THEN {outermost}
        WHEN {first('k')} <= {last('k')} THEN sequence({first('k')}, {last('k')}) ELSE CAST(array() AS ARRAY<BIGINT>) END"""
    cell = "c -> named_struct('level', k, 'cell', c, 'east', CAST(NULL AS BOOLEAN), 'edges', filter(edges, e -> false))"
    return f"flatten(transform(sequence(0, {WIDEST}), k -> transform({at_level}, {cell})))"


def polygon_cover(edges: DataFrame) -> DataFrame:
    """Rows (poly_id, name, row, level, cell, east, edges) from edges (poly_id, name, x1, y1, x2, y2).

    ``level`` BORDER is a boundary cell of one column with its edges and the parity of the crossings east of it, on the
    middle line of the row; level k >= 0 is an inside cell of 2^k columns, the ``cell``-th of them. Polygons may have
    holes and several parts: any closed rings of edges, in any order and direction. Edges with a null are left out.
    """
    ends = [f"IF(e.y1 = e.y2, e.{x}, {AT.format(y=y)})" for x, y in (("x1", "bottom"), ("x2", "top"))]
    pieces = (
        edges.where("x1 <> x2 OR y1 <> y2")
        .selectExpr("poly_id", "name", "struct(x1, y1, x2, y2) AS e", "least(y1, y2) AS low", "greatest(y1, y2) AS high")
        .where("e.x1 + e.y1 + e.x2 + e.y2 IS NOT NULL")
        .selectExpr("*", f"explode(sequence(floor(low / {CELL}D), floor(high / {CELL}D))) AS row")
        .selectExpr("*", f"greatest(low, row * {CELL}D) AS bottom", f"least(high, (row + 1) * {CELL}D) AS top")
        .selectExpr("poly_id", "name", "row", "e", f"least({ends[0]}, {ends[1]}) - {SLACK}D AS x1", f"greatest({ends[0]}, {ends[1]}) + {SLACK}D AS x2")
        .selectExpr("poly_id", "name", "row", "e", f"explode(sequence(floor(x1 / {CELL}D), floor(x2 / {CELL}D))) AS cell")
    )
    here = f"{STRADDLES.format(y=MIDDLE)} AND ceil({AT.format(y=MIDDLE)} / {CELL}D) - 1 = cell"
    border = pieces.groupBy("poly_id", "name", "row", "cell").agg(F.expr("collect_list(e) AS edges"), F.expr(f"count_if({here}) AS hits"))
    eastward = "OVER (PARTITION BY poly_id, name, row ORDER BY cell DESC {})"
    east = f"coalesce(sum(hits) {eastward.format('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}, 0L) AS ahead"
    border = border.selectExpr("*", east, f"lead(cell) {eastward.format('')} + 1 AS a", "cell - 1 AS b")
    # the gap to the next boundary cell in the west is inside if an odd number of crossings lies east of it
    own = f"array(named_struct('level', {BORDER}, 'cell', cell, 'east', ahead % 2 = 1, 'edges', edges))"
    found = f"explode(CASE WHEN a <= b AND (ahead + hits) % 2 = 1 THEN concat({own}, {_inside_cells()}) ELSE {own} END)"
    return border.selectExpr("poly_id", "name", "row", f"{found} AS c").select("poly_id", "name", "row", "c.*")


def places_in_cover(places: DataFrame, cover: DataFrame) -> DataFrame:
    """Rows (_y, _x, poly_id, name) for the polygons that hold each place (_y, _x), a latitude and a longitude."""
    column = f"floor(_x / {CELL}D)"
    levels = [f"struct({BORDER} AS level, {column} AS cell)"] + [f"struct({k} AS level, shiftright({column}, {k}) AS cell)" for k in range(WIDEST + 1)]
    known = "NOT isnan(CAST(_y AS DOUBLE)) AND NOT isnan(CAST(_x AS DOUBLE))"
    at = places.where(known).selectExpr("_y", "_x", f"floor(_y / {CELL}D) AS row", f"explode(array({', '.join(levels)})) AS c")
    met = at.select("_y", "_x", "row", "c.*").join(cover, ["row", "level", "cell"])
    # on the way east to the cell's side, then along the side to the row's middle line
    at_y = AT.format(y="_y")
    ahead = f"coalesce({STRADDLES.format(y='_y')} AND {at_y} > _x AND {at_y} <= {SIDE}, false)"
    beside = f"(((e.x1 > {SIDE}) <> (e.x2 > {SIDE})) AND {BELOW.format(x=SIDE, y='_y')} <> {BELOW.format(x=SIDE, y=MIDDLE)})"
    odd = f"(size(filter(edges, e -> {ahead} <> {beside})) % 2 = 1) <> east"
    return met.where(f"level <> {BORDER} OR {odd}").select("_y", "_x", "poly_id", "name")
