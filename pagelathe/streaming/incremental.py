"""Incremental runs: only what is new or stale is analysed again. Windows over event time are beyond what batch users need, and are Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import cache_state
from ..sources.sinks import write_cache


def stale(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents (doc_id, mtime, sig) to analyse: not in the manifest of what was built, or built from other contents or settings."""
    return cache_state(docs, manifest).filter("state <> 'ok'").drop("state")


def warm(docs: DataFrame, manifest: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Analyses stale documents into the cache at path and returns their rows of the manifest."""
    todo = stale(docs, manifest)
    write_cache(analyse(todo), path)
    return todo.select("doc_id", "mtime", "sig")


def follow(spark: SparkSession, folder: str, schema: str, analyse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Analyses files that came since the last run into the cache, then ends. A batch that is run again overwrites its own documents. A document
    may not be spread over files of different batches."""
    spans = spark.readStream.schema(schema).parquet(folder)
    return spans.writeStream.foreachBatch(lambda batch, _: write_cache(analyse(batch), path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by kind and tumbling window; rows later than `late` behind the newest are not counted in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
