"""Enrichment of page images as they arrive: a wave of files at a time, each page once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import KEY, RESULT, extract, pending, tasks_from_images
from ..session import ship
from ..sources.tables import exists

FORM = RESULT + ", done_at timestamp, wave long"
FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str, suffix: str = ".png", wave: int = 1000) -> DataFrame:
    """(path) of images as they arrive below a folder, ``wave`` files at a time at most; contents are not read."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", wave)
    return found.load(folder).select("path")


def results(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What has been enriched, with the wave of each page; of the waves under ``before`` alone if given."""
    if not exists(spark, path):
        return spark.createDataFrame([], FORM)
    found = spark.read.schema(FORM).parquet(path)
    return found if before is None else found.where(F.col("wave") < before)


def enrich_stream(images: DataFrame, path: str, checkpoint: str, call: Callable[[str], str], tasks_at_once: int | None = None, delay: float = 0.0, once: bool = True, **options) -> StreamingQuery:
    """Enrich the images (path) of a stream into ``path``, a folder a wave.

    A wave that is stopped midway runs again over the same files, and its folder
    is written anew: no page is lost, none is there twice. Pages of earlier
    waves are passed over, however often their files arrive. Calls are spread
    over ``tasks_at_once`` tasks, which wait ``delay`` seconds between them.
    ``once`` takes what is there and ends; else the query goes on.
    """
    spark = images.sparkSession
    ship(spark)

    def wave(files: DataFrame, n: int) -> None:
        todo = tasks_from_images(files).groupBy(*KEY).agg(F.min("path").alias("path"))
        left = pending(todo, results(spark, path, n)).repartition(tasks_at_once or spark.sparkContext.defaultParallelism, *KEY)
        done = extract(left, call, delay=delay, **options).withColumn("done_at", F.current_timestamp())
        done.write.mode("overwrite").parquet(f"{path}/wave={n}")

    writer = images.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
