"""Connected components of a link table, by alternating star steps on the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """Rows (u, v), u > v: every linked node with the smallest node of its component, which has no row itself.

    ``links`` has long columns u and v. Each step keeps at most the links it got: a node is linked to the smallest
    node it knows, never to all nodes of its group. Minima combine before the shuffle, a node with very many links
    is split by adaptive execution. The lineage is cut by a checkpoint in the shared folder after every round.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    links = cut_lineage(links)
    state = _state(links)
    while True:
        # larger neighbours to the smallest neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # smaller neighbours, and the node itself, to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, _state(links)
        if last == state:
            return links
