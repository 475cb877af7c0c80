"""Incremental processing of a stream of files: only what changed goes on, with the state kept as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import last_wins


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (file_path, content_hash, …) whose hash the state (file_path, content_hash) does not hold."""
    known = state.select(F.lower("file_path").alias("__k"), F.col("content_hash").alias("__h"))
    fresh = files.withColumn("__k", F.lower("file_path"))
    return fresh.join(known, (fresh["__k"] == known["__k"]) & (F.col("content_hash") == F.col("__h")), "left_anti").drop("__k")


def start(spark: SparkSession, source: str, state_path: str, checkpoint: str, process: Callable[[DataFrame], None], schema: str = "file_path string, content string", once: bool = True):
    """Follow JSON-lines files below ``source``; ``process`` gets each batch's changed files; the state is parquet by batch."""
    stream = spark.readStream.schema(schema).json(source).withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))

    def batch(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        latest = last_wins(rows, ["file_path"], "content_hash")
        try:
            held = last_wins(session.read.parquet(state_path), ["file_path"], "batch").select("file_path", "content_hash")
        except Exception as e:  # the first batch finds no state
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = session.createDataFrame([], "file_path string, content_hash string")
        new = changed(latest, held)
        process(new)
        new.select("file_path", "content_hash", F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(state_path)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and window of ``ts``; rows later than ``late`` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
