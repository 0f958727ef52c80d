"""Runs that end, from a stream of progress messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.progress import is_end, parse_messages


def read_messages(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of text files as they come: (value, ts), where ts is when a file was written."""
    lines = spark.readStream.format("text").load(directory)
    return lines.select("value", F.col("_metadata.file_modification_time").alias("ts"))


def finished_runs(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(prompt_id, ts) of each run's end; a repeated message counts once within the watermark."""
    ends = parse_messages(frames).where(is_end()).select("prompt_id", "ts")
    return ends.withWatermark("ts", late).dropDuplicatesWithinWatermark(["prompt_id"])


def runs_with_timeout(submitted: DataFrame, ends: DataFrame, limit: str = "10 minutes") -> DataFrame:
    """(prompt_id, submitted_at, done_at) of submitted runs (prompt_id, ts); done_at is null once the limit has passed
    without an end. The limit is an addition: a run that never ends would keep its state for ever."""
    a = submitted.select(F.col("prompt_id"), F.col("ts").alias("submitted_at")).withWatermark("submitted_at", "1 minute").alias("a")
    b = ends.select(F.col("prompt_id").alias("ended"), F.col("ts").alias("done_at")).withWatermark("done_at", "1 minute").alias("b")
    on = F.expr(f"prompt_id = ended AND done_at >= submitted_at AND done_at <= submitted_at + INTERVAL {limit}")
    return a.join(b, on, "leftOuter").select("prompt_id", "submitted_at", "done_at")
