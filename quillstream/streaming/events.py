"""Streams of events: daily counts, a view counter, first occurrences, sessions. Each has a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type; a day is closed once the watermark has passed it."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], within: str = "48 hours") -> DataFrame:
    """The first event of each key; repeats within the time are dropped, with bounded state."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, parted by a gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then stop; into an in-memory table for tests and small results."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
