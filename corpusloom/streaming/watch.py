"""Watching a folder: a file stream whose micro-batches are merged into a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators.incremental import VersionedTable


def watch(spark: SparkSession, folder: str, schema: StructType, table: VersionedTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, seconds: int | None = None, key: str = "source_id") -> StreamingQuery:
    """Starts the stream. Every batch replaces the documents that it brings; a batch that runs again gives the same table. Without seconds it takes what is there and ends."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = transform(batch)
        if not fresh.isEmpty():
            table.upsert(fresh, key)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; works on streams, with a watermark, and on tables. An extra: the corpus model has no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
