"""Query registry: a Spark plan over the given tables, plus the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import Lake
from .ctes import expand


@dataclass(frozen=True)
class RegisteredQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, RegisteredQuery] = {}


def nudge(digits: int) -> float:
    """Tiny shift before rounding, so that an exact tie does not hang on the last bit of a sum."""
    return float(f"3.7e-{digits + 3}")


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(lake)``; ``doubles`` are rounded to ``digits`` on both sides before comparing."""

    cols = doubles.split()

    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.round(F.col(c) + nudge(digits), digits) for c in cols}) if cols else df

    def register(fn: Callable[[Lake], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Lake(spark, sf_dir)))

        text = None
        if sql is not None:
            rounding = ", ".join(f"round({c} + {nudge(digits)}, {digits}) AS {c}" for c in cols)
            replace = f" REPLACE ({rounding})" if rounding else ""
            text = f"{expand(sql)} SELECT *{replace} FROM ({sql}) AS result"
        REGISTRY[name] = RegisteredQuery(run, text)
        return fn

    return register
