"""Writing answers, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(rows: DataFrame, path: str) -> None:
    """Answers as JSON lines, one file per partition, so that the write scales."""
    rows.write.mode("overwrite").json(path)


def results_by_file(rows: DataFrame, path: str) -> None:
    """Results in a folder per file; only the folders of the files at hand are replaced."""
    spread = rows.repartition("filename", F.pmod(F.xxhash64("page"), F.lit(16)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filename").parquet(path)


def report(scores: DataFrame, path: str) -> None:
    """A small report (one row per group) as one JSON file."""
    scores.coalesce(1).write.mode("overwrite").json(path)
