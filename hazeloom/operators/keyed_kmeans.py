"""k-means in the plane for many groups at once.

The centres of a group are an array next to its name, so one pass assigns the places of all groups and moves all centres:
weighted sums combine map-side, and the number of jobs does not depend on the number of groups. Starting centres are
chosen farthest first, so the same places always give the same clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

MOST_ROUNDS = 100
#: A centre that moves no farther has stayed.
STILL = 1e-9

_D2 = "pow(c.x - x, 2) + pow(c.y - y, 2)"
_NEAREST = f"array_min(transform(centres, (c, i) -> struct({_D2} AS d2, i AS cluster)))"


def keyed_kmeans(points: DataFrame, group: str, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct places (group, x, y) with ``cluster`` (from 0) and ``n_clusters``, at most ``k`` clusters a group.

    A place weighs as many points as it has. A group of fewer than ``k`` places gets a cluster for each. A null group is
    a group; points without coordinates are left out. Each place ends with the centre nearest to it, the smaller cluster
    on ties, and each centre is the mean of its points; if that is not reached within MOST_ROUNDS rounds, it raises.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    places = known.groupBy(F.col(group).alias("of"), key.alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    places = stored(places, "places")
    centres = stored(places.groupBy("g").agg(F.array(F.min(F.struct("x", "y"))).alias("centres")), "centres")
    for _ in range(k - 1):
        far = places.join(centres, "g").selectExpr("g", "x", "y", f"{_NEAREST}.d2 AS d2").where("d2 > 0")
        far = far.groupBy("g").agg(F.max(F.struct("d2", "x", "y")).alias("far"))
        grown = centres.join(far, "g", "left")
        centres = stored(grown.selectExpr("g", "IF(far IS NULL, centres, array_append(centres, struct(far.x AS x, far.y AS y))) AS centres"), "centres")
    for _ in range(MOST_ROUNDS):
        near = places.join(centres, "g").selectExpr("g", "x", "y", "n", f"{_NEAREST}.cluster AS cluster")
        means = near.groupBy("g", "cluster").agg((F.sum(F.expr("n * x")) / F.sum("n")).alias("x"), (F.sum(F.expr("n * y")) / F.sum("n")).alias("y"))
        moved = means.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("cluster", "x", "y"))).alias("means"))
        after = centres.join(moved, "g").selectExpr(
            "g", "transform(means, m -> struct(m.x AS x, m.y AS y)) AS centres",
            f"size(means) < size(centres) OR exists(means, m -> sqrt(pow(m.x - centres[m.cluster].x, 2) + pow(m.y - centres[m.cluster].y, 2)) > {STILL}) AS moved",
        )
        after = stored(after, "centres")
        centres = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"centres still move after {MOST_ROUNDS} rounds")
    found = places.join(centres, "g").selectExpr("of", "x", "y", f"{_NEAREST}.cluster AS cluster", "CAST(size(centres) AS BIGINT) AS n_clusters")
    return found.withColumnsRenamed({"of": group, "x": x, "y": y})
