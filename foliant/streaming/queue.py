"""Streaming forms of the queue folds: state by key from a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_log(spark, path: str, schema) -> DataFrame:
    """The write log as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def distinct_writes(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Writes without second deliveries, whose state is dropped when the watermark passes them."""
    return log.withColumn("logged_at", F.col("logged_time").cast("timestamp")).withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["log_id"])


def latest_positions(log: DataFrame) -> DataFrame:
    """The last written position of each (user, pod, episode), as a running (update or complete) result."""
    last = F.max(F.struct("logged_time", "log_id", "start_pos", F.coalesce("model_name", F.lit("")).alias("model_name")))
    state = log.where("user_id IS NOT NULL AND episode_idx IS NOT NULL").groupBy("user_id", "pod_id", "episode_idx").agg(last.alias("last"))
    return state.select("user_id", "pod_id", "episode_idx", "last.start_pos", "last.model_name")


def hourly_activity(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Writes per hour and pod, final once the watermark has passed the hour."""
    at = log.withColumn("logged_at", F.col("logged_time").cast("timestamp")).withWatermark("logged_at", late)
    return at.groupBy(F.window("logged_at", "1 hour"), "pod_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "pod_id", "n")
