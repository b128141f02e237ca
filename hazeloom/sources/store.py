"""Date-partitioned feature store: pruned scans, idempotent writes, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GRID_CELLS
from ..functions.ids import cell_id
from ..functions.timecols import ensure_date_column


class FeatureStore:
    """Tables under one root, each a Parquet directory partitioned by ``date``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def _listing(self, stage: str) -> list[str]:
        """Names of the stage's partitions, or of its files where it has none; lists files, opens none."""
        folder = self.path(stage)
        try:
            files = self.spark.read.schema("_none int").parquet(folder).inputFiles()
        except AnalysisException:  # no such folder
            return []
        cut = [re.split(r"/(?=date=)", f, maxsplit=1) for f in files]
        return sorted({parts[-1].split("/")[0] if len(parts) > 1 else f.rsplit("/", 1)[-1] for parts, f in zip(cut, files)})

    def exists(self, stage: str) -> bool:
        return bool(self._listing(stage))

    def read(
        self,
        stage: str,
        start: str | None = None,
        end: str | None = None,
        dates: Iterable[str] | None = None,
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        """Rows of an inclusive range or of listed dates; requested columns that do not exist are skipped."""
        df = self.spark.read.parquet(self.path(stage)).withColumn("date", F.col("date").cast("date"))
        if start is not None:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("date") <= F.lit(end).cast("date"))
        if dates is not None:
            df = df.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
        if columns is not None:
            df = df.select(*[c for c in dict.fromkeys([*columns, "date"]) if c in df.columns])
        return df

    def read_date(self, stage: str, date: str, columns: Sequence[str] | None = None) -> DataFrame:
        return self.read(stage, dates=[date], columns=columns)

    def read_all(self, stages: Sequence[str], start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
        return {s: self.read(s, start, end) for s in stages if self.exists(s)}

    def read_master(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The master table, at the root itself or under ``master``."""
        stage = "master" if self.exists("master") else "."
        return self.read(stage, start, end)

    def dates(self, stage: str) -> DataFrame:
        """Available dates from the directory names: one row per calendar day, no file is opened."""
        names = [n.removeprefix("date=") for n in self._listing(stage) if n.startswith("date=")]
        rows = self.spark.createDataFrame([(n,) for n in sorted(names)], "date string")
        return rows.select(F.col("date").try_cast("date").alias("date")).where("date IS NOT NULL")

    def date_span(self, stage: str) -> DataFrame:
        return self.dates(stage).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    def write(self, stage: str, df: DataFrame, overwrite: bool = False) -> int:
        """Writes whole dates; a date already present is skipped, or replaced with ``overwrite``.

        Returns how many dates the store gained, from the directory names.  Replacing uses dynamic
        partition overwrite, so other dates stay and a failed task leaves no trace.  Rows are
        rebalanced by date, so adaptive execution gives a heavy date several writers and light dates one.
        """
        dated = ensure_date_column(df)
        before = set(self._listing(stage))
        if before and not overwrite:
            dated = dated.join(self.dates(stage), "date", "left_anti")
        dated = dated.hint("rebalance", F.col("date"))
        writer = dated.write.partitionBy("date").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(self.path(stage))
        return sum(n.startswith("date=") for n in set(self._listing(stage)) - before)

    def remove_dates(self, stage: str, dates: Iterable) -> None:
        """Deletes the partitions of these dates; dates that are not there do not matter."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for date in dates:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path(stage)}/date={date}")
            path.getFileSystem(conf).delete(path, True)

    def write_grid(self, stage: str, df: DataFrame, overwrite: bool = False, expected_rows: int = GRID_CELLS) -> DataFrame:
        """Grid stage with cell ids; returns the dates whose row count is not the grid's."""
        dated = ensure_date_column(df)
        if "cell_id" not in dated.columns:
            if not {"lat", "lon"} <= set(dated.columns):
                raise ValueError("a grid stage needs cell_id, or lat and lon")
            dated = dated.withColumn("cell_id", cell_id(F.col("lat"), F.col("lon")))
        before = set(self._listing(stage))
        self.write(stage, dated, overwrite)
        touched = dated.select("date").distinct()
        if not overwrite:  # dates that were there are as they were
            new = [n.removeprefix("date=") for n in self._listing(stage) if n not in before]
            touched = self.spark.createDataFrame([(n,) for n in new], "date string").select(F.col("date").cast("date").alias("date"))
        return self.read(stage).join(touched, "date", "left_semi").groupBy("date").count().where(F.col("count") != expected_rows)

    def write_table(self, name: str, df: DataFrame, fmt: str = "parquet") -> None:
        """Unpartitioned export; CSV doubles carry all significant digits."""
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(self.path(name))
        else:
            writer.format(fmt).save(self.path(name))


def missing_dates(observations: DataFrame, done: DataFrame) -> DataFrame:
    """Observation rows whose date has no partition yet.  Dates are at most one row per calendar day."""
    return observations.join(done.select("date").distinct(), "date", "left_anti")


def sync_plan(remote: DataFrame, local: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per dataset, how many remote partitions of the range are to copy and how many are already here."""
    wanted = remote
    if start is not None:
        wanted = wanted.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        wanted = wanted.where(F.col("date") <= F.lit(end).cast("date"))
    have = local.select("dataset", "date").distinct().withColumn("_have", F.lit(1))
    both = wanted.select("dataset", "date").distinct().join(have, ["dataset", "date"], "left")
    return both.groupBy("dataset").agg(
        F.count(F.when(F.col("_have").isNull(), 1)).alias("to_sync"), F.count("_have").alias("skipped")
    )


def lake_manifest(partitions: DataFrame) -> DataFrame:
    """Partition count and date span per dataset; names that are not dates do not count."""
    parsed = partitions.withColumn("date", F.col("partition").try_cast("date")).where("date IS NOT NULL")
    return parsed.groupBy("dataset").agg(
        F.countDistinct("date").alias("n_partitions"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )



__all__ = ["FeatureStore", "lake_manifest", "missing_dates", "sync_plan"]
