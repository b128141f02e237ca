"""Feature names: which stage and which family a column belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AOD_PATTERNS,
    GAS_PATTERNS,
    GAS_STAGE,
    MET_PATTERNS,
    META_NAMES,
    META_PREFIXES,
    STAGES,
    STATIC_PATTERNS,
)


def _any_match(name: Column, patterns: Sequence[str]) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in patterns))


def feature_stage(name: Column) -> Column:
    """Stage by name alone; the first matching rule wins."""
    n = F.lower(name)
    meta = n.isin(META_NAMES)
    for prefix in META_PREFIXES:
        meta = meta | n.startswith(prefix)
    return (
        F.when(meta, "meta")
        .when(_any_match(n, STATIC_PATTERNS), "static")
        .when(_any_match(n, MET_PATTERNS), "met")
        .when(_any_match(n, AOD_PATTERNS), "aod")
        .when(_any_match(n, GAS_PATTERNS), GAS_STAGE)
        .otherwise("unknown")
    )


def classify_features(names: DataFrame, registry: DataFrame | None = None, name: str = "column_name") -> DataFrame:
    """Stage per feature name; a registered stage overrides the pattern rules."""
    by_name = feature_stage(F.col(name))
    if registry is None:
        return names.withColumn("stage", by_name)
    reg = registry.select(F.col(name), F.lower(F.trim("stage")).alias("_registered"))
    known = F.when(F.col("_registered").isin(STAGES), F.col("_registered")).otherwise("unknown")
    out = names.join(reg, name, "left")
    return out.withColumn("stage", F.when(F.col("_registered").isNull(), by_name).otherwise(known)).drop("_registered")


def feature_family(name: Column, stage: Column) -> Column:
    """Ablation family; ammonia is split off the gas stage and everything else counts as weather."""
    return (
        F.when(stage == "aod", "AOD")
        .when((stage == GAS_STAGE) & name.startswith("nh3_"), "NH3")
        .when(stage == GAS_STAGE, "TROPOMI")
        .otherwise("MET")
    )
