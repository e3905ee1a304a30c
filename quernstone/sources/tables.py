"""Tables that grow while a job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def earlier_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a former run wrote; no rows if it wrote nothing."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def added(rows: DataFrame, path: str) -> None:
    """Add rows as new files, which show all together when the write is done."""
    rows.write.mode("append").parquet(path)
