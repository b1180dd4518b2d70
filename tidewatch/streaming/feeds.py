"""Incremental ingestion of feeds and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_items(items: DataFrame, url: str = "url", time: str | None = None, late: str = "30 days") -> DataFrame:
    """Items whose canonical address was not seen before. With a time column, state older than the delay is dropped."""
    keyed = items.withColumn("canonical_url", canonical_url(F.col(url)))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["canonical_url"]) if time else keyed.dropDuplicates(["canonical_url"])


def window_counts(events: DataFrame, time: str, by: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts per window and value; in a stream, windows older than the delay are final."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there in micro-batches, resuming at the checkpoint. A batch that is run again has the same id, so
    writers that replace by id are idempotent."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
