"""Chunks of pages as they arrive; an extension of ours on top of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import page_chunks
from ..sources.readers import PAGE


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE).json(folder)


def chunk_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append page chunks as Parquet, each input file once."""
    return page_chunks(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
