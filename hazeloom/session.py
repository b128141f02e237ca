"""Session helpers: settings the operators rely on, and lineage cutting in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own through spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hazeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # call sites are not recorded per column expression, which makes wide plans faster to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


T = TypeVar("T")
#: Fits that run at the same time.
PARALLEL = 3


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], parallel: int = PARALLEL) -> list[T]:
    """Results of Spark jobs in the order given, a few running at a time: one fills the cores that another leaves idle."""
    pool = ThreadPool(max(1, min(parallel, len(jobs) or 1)))
    try:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)
    finally:
        pool.close()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _LOCAL_FOLDERS.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _LOCAL_FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, unique per call."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage ends there and the size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
