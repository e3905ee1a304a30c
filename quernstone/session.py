"""Session settings, and making this package known to Python workers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "quernstone", master: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; sizes stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the cluster has not installed it on their path."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that is an error, since executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for tables that come in a few files or row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def estimated(df: DataFrame) -> int:
    """Catalyst's estimate of the table in bytes; of a table of files what their columns take there."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether Catalyst's estimate of the table is within ``limit`` bytes: the check before a broadcast."""
    return estimated(df) <= limit


def pieces(df: DataFrame, each: int = 1 << 17, most: int = 4096) -> int | None:
    """Partitions of about ``each`` estimated bytes, from the number of cores to ``most``; None where the size is unknown.

    What a task makes of its rows (words, counts, sums) is many times their size.
    Adaptive execution joins small partitions until there is one a core, so that
    a task's tables grow with the input and spill; these stay as they are.
    """
    size = estimated(df)
    return None if size >= 1 << 50 else max(df.sparkSession.sparkContext.defaultParallelism, min(most, -(-size // each)))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by the hash of some columns, or evenly, over as many partitions as ``pieces`` says."""
    n = pieces(df)
    return df.repartition(*by) if n is None else df.repartition(n, *by)


def beside(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, which is made of ``source``, marked for a join: broadcast if the source is small, else hashed after a shuffle.

    The terms of a text are some ten times its size as rows, hence the low limit.
    """
    return F.broadcast(df) if small(source, 2 << 20) else df.hint("shuffle_hash")
