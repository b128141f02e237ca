"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, segmentation into pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeloom.llm import chunk_dedup, mixing, quality_lines, segmentation, simhash
from hazeloom.llm.common import fresh, stored, table
from hazeloom.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the lines that fail a rule go."""
    return _counted(quality_lines.keep_clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, but for their first occurrence; documents without a word left go too."""
    (found,) = fresh(docs, "_dedup")
    cut = chunk_dedup.without_repeats(docs, "doc_id", "text", found)
    left = cut.withColumn("text", F.col(found)["text"]).where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return _counted(left.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row for each time."""
    return mixing.mix(docs, "doc_id", "text", "source")


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document; a text that decoding would not give back fails the stage."""
    coded = segmentation.segmented(docs.select("doc_id", "lang", "source", "text"), "doc_id", "text", PIECES)
    lost = F.raise_error(F.lit("a text is not given back")).cast("array<int>")
    ids = F.when(F.col("restored"), F.col("ids")).otherwise(lost)
    return coded.select("doc_id", "lang", "source", F.size(ids).alias("n_tokens"), ids.alias("ids"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("segment", segment)]

#: Sampled mixing and segmentation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
