"""Putting stages together: keyed joins, the master table, the registry and quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantile import column_medians


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order.

    An aggregate rather than ``row_number``: it combines map-side, so a key with very many copies
    never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(row.alias("_f")).select(*keys, "_f._row.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], examples: int = 5) -> DataFrame:
    """Fails, naming a few keys, unless every key is unique."""
    bad = duplicate_keys(df, keys).orderBy(*keys).limit(examples).collect()
    if bad:
        raise ValueError(f"duplicate keys {list(keys)}: {[tuple(r) for r in bad]}")
    return df


def join_stages(
    base: DataFrame,
    stages: Mapping[str, DataFrame],
    keys: Sequence[str],
    order: Mapping[str, Sequence[str]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """Left joins of feature stages on date-typed keys; clashing names get the stage as suffix.

    Repeated keys of a stage keep the first row in that stage's order.
    """

    def typed(df: DataFrame) -> DataFrame:
        return df.withColumn("date", F.to_date("date")) if "date" in keys else df

    out = typed(base)
    for name, stage in stages.items():
        side = dedup_first(typed(stage).drop(*[d for d in drop if d not in keys]), keys, order[name])
        clash = [c for c in side.columns if c not in keys and c in out.columns]
        out = out.join(side.withColumnsRenamed({c: f"{c}_{name}" for c in clash}), list(keys), "left")
    return out


def join_grid_stages(base: DataFrame, stages: Sequence[DataFrame]) -> DataFrame:
    """Left joins on (cell_id, date), or on (lat, lon, date) for a stage without cell ids."""
    out = base
    for stage in stages:
        keys = ["cell_id", "date"] if "cell_id" in stage.columns and "cell_id" in out.columns else ["lat", "lon", "date"]
        out = out.join(stage.drop(*[c for c in stage.columns if c in out.columns and c not in keys]), keys, "left")
    return out


def master_summary(df: DataFrame, families: Mapping[str, Sequence[str]], date: str = "date") -> DataFrame:
    counts = [F.lit(len([c for c in cols if c in df.columns])).alias(f"n_{name}") for name, cols in families.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).select(
        "*", *counts
    )


def master_update(
    master: DataFrame, new: DataFrame, keys: Sequence[str], features: Sequence[str], contract: Sequence[str]
) -> DataFrame:
    """Replaces feature columns of the master by their new versions and keeps the contract's columns.

    The new table's keys must be unique: the join asserts it per key, without a separate pass.
    """
    update = [c for c in features if c in new.columns]
    one = F.when(F.count(F.lit(1)) == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("duplicate key in update: "), F.concat_ws(",", *[F.first(k).cast("string") for k in keys])))
    )
    side = new.groupBy(*keys).agg(one.alias("_one"), *[F.first(c).alias(c) for c in update]).where("_one").drop("_one")
    joined = master.drop(*update).join(side, list(keys), "left")
    return joined.select(*[c for c in dict.fromkeys([*keys, *contract]) if c in joined.columns])


def snapshot_daily_merge(snapshot: DataFrame, daily: DataFrame, snap: DataFrame, key: str = "sensor_id", time: str = "date"):
    """Snapshot rows with daily aggregates of the day and snapping facts of the station."""
    return snapshot.join(daily, [key, time], "left").join(snap, key, "left")


def registry_upsert(registry: DataFrame, new: DataFrame, key: str = "column_name") -> DataFrame:
    """New rows replace rows of the same name; booleans are stored as 0/1."""
    merged = registry.join(new.select(key), key, "left_anti").unionByName(new)
    flags = [f.name for f in merged.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return merged.withColumns({c: F.col(c).cast("int") for c in flags})


def registry_summary(registry: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Columns per stage and category; absent combinations count 0."""
    return registry.groupBy("stage").pivot("category", list(categories)).agg(F.count(F.lit(1))).na.fill(0)


def validate_stage_output(
    df: DataFrame, expected: Sequence[str], keys: Sequence[str], target: str = "pm25", allowed_text: Sequence[str] = ("_reason", "_used", "_available")
) -> DataFrame:
    """Issue rows (issue, column_name, n_rows) from the schema, each with the size of the table checked."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    have = set(df.columns)
    issues = [("missing_feature", c) for c in expected if c not in have]
    issues += [("missing_key", c) for c in keys if c not in have]
    issues += [("target_leakage", c) for c in expected if target in c.lower() and c != target]
    issues += [("non_numeric", c) for c in expected if c in have and c not in numeric and not c.endswith(tuple(allowed_text))]
    pairs = F.array(*[F.struct(F.lit(i).alias("issue"), F.lit(c).alias("column_name")) for i, c in issues])
    if not issues:
        pairs = F.array().cast("array<struct<issue:string,column_name:string>>")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("_i", F.explode(pairs)).select("_i.issue", "_i.column_name", "n_rows")


def feature_coverage(df: DataFrame, columns: Sequence[str], least: float = 0.01, keep_all_below: int = 0) -> DataFrame:
    """Known share per column, and whether it is kept; nothing is dropped if fewer than ``keep_all_below`` would remain."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    long = shares.unpivot([], list(columns), "column_name", "coverage")
    passing = long.agg(F.sum((F.col("coverage") >= least).cast("int"))).scalar()
    keep = (F.col("coverage") >= least) | (passing < keep_all_below)
    return long.withColumn("keep", keep.cast("int"))


def fit_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians as rows (column, median)."""
    return column_medians(df, columns)


def median_impute(df: DataFrame, columns: Sequence[str], train_medians: DataFrame | None) -> DataFrame:
    """Gaps filled with the training medians, else the table's own, and 0 where neither exists."""
    medians = fit_medians(df, columns) if train_medians is None else train_medians
    # one row of one struct: a field is found by position, where a map would be searched for every value
    fields = [F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"m{i}") for i, c in enumerate(columns)]
    table = medians.agg(F.struct(*fields).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), table[f"m{i}"], F.lit(0.0)) for i, c in enumerate(columns)})


def null_shares(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (column_name, null_share), from one aggregate over all columns."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column_name", "null_share")


def top_null_features(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    shares = null_shares(df, columns).where("null_share > 0")
    return shares.orderBy(F.desc("null_share"), "column_name").limit(n)


def data_quality_report(df: DataFrame, stages: Mapping[str, Sequence[str]], required: Sequence[str], inside: Column, date: str = "date"):
    """Per-day quality document over in-country cells: null shares and coverage per stage as maps."""
    available = [c for c in required if c in df.columns]

    def share(columns: Sequence[str]) -> Column:
        nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
        return F.avg(nulls / F.lit(float(len(columns))))

    coverage, null_share, counts = [], [], []
    for stage, columns in stages.items():
        have = [c for c in columns if c in df.columns]
        used = [c for c in have if c in required]
        any_value = F.coalesce(*[F.col(c).cast("string") for c in have]).isNotNull() if have else F.lit(False)
        coverage += [F.lit(stage), F.round(F.avg(any_value.cast("double")), 4)]
        null_share += [F.lit(stage), F.round(share(used or have), 4) if have else F.lit(1.0)]
        counts += [F.lit(stage), F.lit(len(used))]
    return df.where(inside).groupBy(date).agg(
        F.lit(len(required)).alias("total_features"),
        F.lit(len(required) - len(available)).alias("missing_features"),
        F.lit(len(available)).alias("available_features"),
        F.round(share(available), 4).alias("nan_fraction"),
        F.count(F.lit(1)).alias("country_cells"),
        F.create_map(*coverage).alias("stage_coverage"),
        F.create_map(*null_share).alias("stage_nan_fraction"),
        F.create_map(*counts).alias("stage_feature_count"),
    )


def flatten_quality(documents: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Map columns of quality documents as one column per stage."""
    maps = {"coverage": "stage_coverage", "nan": "stage_nan_fraction", "features": "stage_feature_count"}
    plain = [c for c in documents.columns if c not in maps.values()]
    return documents.select(
        *plain, *[F.try_element_at(m, F.lit(s)).alias(f"{s}_{n}") for n, m in maps.items() for s in stages]
    )


def union_partitions(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by name; columns a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distinct_sites(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon", order: str = "date") -> DataFrame:
    """One row per site with the coordinates seen first."""
    first = F.min(F.struct(F.col(order), F.col(lat), F.col(lon)))
    return df.groupBy(key).agg(first.alias("_f")).select(key, f"_f.{lat}", f"_f.{lon}")
