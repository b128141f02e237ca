"""Mixing sources to target weights by pivotal dependent rounding.

The sources share the words of all documents by weight, up to a multiple of their own words; what is above is
shared again (a water level over the sources). A document is taken floor(r) times for its source's target / size r,
and once more with the fraction as probability. The fractions are rounded together: two documents are paired, and
words move from one to the other until one of them is whole, the direction drawn so that each probability stays
right. The sum of words never changes by that, so a source comes as near to its target as its last open document.

The pairing is a tree of bounded groups: documents in buckets of a source, then the open document of each bucket
with those of other buckets, and so on; a hot source is just more buckets. Draws are seeded by the place in the
tree and ties broken by content, so a rerun or a lost executor gives the same mix.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 1024
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, sid, source_size, target, buckets) from rows (source, size); one row per source, nulls too.

    Sources are few against documents: they are ordered in one task after the sums. ``sid`` numbers them by code
    point, null last, and WEIGHTS repeat over that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("weight", F.get(weights, F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS)))))
    per = per.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("reach", F.col("cap") / F.col("weight"))
    up = Window.orderBy("reach", "sid")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumns({"capped": (total - before) / rest >= F.col("reach"), "total": total})
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(Window.partitionBy()), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * left / open_weight)
    return per.select(
        "source", "sid", "source_size", target.alias("target"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets")
    )


def pivotal(sizes: list[int], x: list[float], seed: str) -> tuple[list[int], int]:
    """0 or 1 for each entry, and the index of the one entry left open (-1: none), whose x is updated in place."""
    draw = random.Random(seed).random
    done, at = [0] * len(x), -1
    for j, (size, share) in enumerate(zip(sizes, x)):
        if size <= 0 or share <= 0:
            continue
        if share >= 1:
            done[j] = 1
            continue
        if at < 0:
            at = j
            continue
        own, other = x[at] * sizes[at], share * size
        up, down = min(sizes[at] - own, other), min(own, size - other)
        if draw() * (up + down) < down:  # words move from j to the open one
            filled, emptied = sizes[at] - own <= other, other <= sizes[at] - own
            own, other = own + up, other - up
            at_whole, j_whole = filled, emptied
            done[at], done[j] = (1 if filled else 0), 0
        else:
            emptied, filled = own <= size - other, size - other <= own
            own, other = own - down, other + down
            at_whole, j_whole = emptied, filled
            done[at], done[j] = 0, (1 if filled else 0)
        x[at], x[j] = own / sizes[at], other / size
        at = j if at_whole and not j_whole else (-1 if at_whole else at)
    return done, at


def _rounded(level: int, last: bool):
    """Group function over columns sid, bucket, size, tie, share; adds extra (0 or 1), open and left."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        size, tie = (group.column(c).to_numpy() for c in ("size", "tie"))
        order = np.lexsort((tie, -size))
        x = group.column("share").to_numpy()[order].tolist()
        done, at = pivotal(size[order].tolist(), x, f"{SEED}/{level}/{key[0].as_py()}/{key[1].as_py()}")
        if last and at >= 0:  # nothing is left to pair it with
            done[at], at = int(x[at] >= 0.5), -1
        extra, opened, left = np.zeros(len(x), np.int32), np.zeros(len(x), bool), np.zeros(len(x))
        extra[order] = done
        if at >= 0:
            opened[order[at]], left[order[at]] = True, x[at]
        for name, column in (("extra", extra), ("open", opened), ("left", left)):
            group = group.append_column(name, pa.array(column))
        return group

    return run


def _round(rows: DataFrame, level: int, last: bool) -> DataFrame:
    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructType

    schema = StructType(list(rows.schema.fields))
    schema = schema.add("extra", IntegerType()).add("open", BooleanType()).add("left", DoubleType())
    return rows.groupBy("sid", "bucket").applyInArrow(_rounded(level, last), schema)


def mixed(df: DataFrame, key: str, text: str, source: str, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) of ``df`` in a struct ``row``, and size, source_size, target, copies (how
    often a document is taken).

    Sizes are words; a null or empty text has none and is taken floor(r) times without weight in the sums. Null
    sources are one source, ordered last. Repeated rows are documents of their own. An empty table gives no rows.
    """
    t = df.select(
        F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        F.xxhash64(F.col(key), F.col(text)).alias("tie"),
        F.struct(*(carry or df.columns)).alias("row"),
    )
    targets = stored(source_targets(t), "targets")
    s = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target", "buckets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.join(s, F.col("source").eqNullSafe(F.col("_source"))).select(
        "sid",
        F.pmod(F.col("tie"), F.col("buckets")).alias("bucket"),
        "size",
        "tie",
        (ratio - F.floor(ratio)).alias("share"),
        F.floor(ratio).cast("int").alias("whole"),
        "source_size",
        "target",
        "row",
    )
    # the tree above the buckets, on the open entries alone
    fields = ["sid", "bucket", "size", "tie", "share"]
    entries = _round(t.select(*fields), 0, False).where("open")
    entries = stored(entries.select("sid", F.col("bucket").alias("at"), "bucket", "size", "tie", F.col("left").alias("share")), "open")
    most = targets.agg(F.max("buckets")).first()[0] or 1
    level, settled = 1, []
    while True:
        last = most <= BUCKET_ROWS
        entries = entries.withColumn("bucket", F.floor(F.col("bucket") / BUCKET_ROWS))
        out = stored(_round(entries, level, last), "level")
        settled.append(out.where("not open").select("sid", F.col("at").alias("bucket"), F.col("extra").alias("late")))
        if last:
            break
        entries = out.where("open").select("sid", "at", "bucket", "size", "tie", F.col("left").alias("share"))
        most, level = -(-most // BUCKET_ROWS), level + 1
    late = settled[0]
    for more in settled[1:]:
        late = late.union(more)

    done = _round(t, 0, False).join(late, ["sid", "bucket"], "left")
    extra = F.when(F.col("open"), F.coalesce("late", F.lit(0))).otherwise(F.col("extra"))
    return done.select("row", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def mix(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Each row as often as it is taken; the columns of ``df``."""
    out = mixed(df, key, text, source).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns])
