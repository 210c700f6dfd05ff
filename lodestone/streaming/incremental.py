"""Streaming forms: merged groups kept up to date batch by batch, event-time windows with late rows dropped, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_parquet(spark: SparkSession, folder: str, schema, *, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, each once, those that come later too."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def merged_stream(edges: DataFrame, keys: Sequence[str], confidence: str, evidence: str) -> DataFrame:
    """Running groups of a stream of edges: the highest confidence, evidence summed; for output mode complete or update."""
    return edges.groupBy(*keys).agg(F.max(confidence).alias(confidence), F.sum(evidence).alias(evidence))


def windowed(events: DataFrame, time: str, keys: Sequence[str], value: str, *, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and window; rows later than the watermark are dropped in a stream."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, *, gap: str) -> DataFrame:
    """(start, end, key, n) of runs of a key's events no further apart than gap; events at one time share theirs, null times have none."""
    out = events.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, *, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the in-memory result; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
