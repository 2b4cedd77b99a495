"""Batches that arrive over time: the operators over files that are added to a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder. Filters and projections apply to it as to any frame."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def running_aggregate(stream: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """The aggregates of all that has arrived, kept as partial state a group."""
    return stream.groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, complete: bool = False) -> StreamingQuery:
    """Hands on all that is there, batch by batch, and ends."""
    writer = stream.writeStream.foreachBatch(handle).outputMode("complete" if complete else "append").option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
