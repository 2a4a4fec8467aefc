"""Structured Streaming jobs on events and articles; each has a batch twin with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type. In a stream the watermark bounds state; rows later than it are left to split_late."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of one user's events with pauses below the gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def split_late(events: DataFrame, arrival: str, late_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows that arrive more than late_seconds after their time go to a batch re-run, not to the stream."""
    lag = F.unix_micros(arrival) - F.unix_micros("ts")
    ok = lag <= late_seconds * 1_000_000
    return events.filter(ok), events.filter(~ok)


def first_seen(articles: DataFrame, key: str, time: str, within: str = "96 hours") -> DataFrame:
    """The first row of each key; a stream forgets keys after the watermark."""
    if articles.isStreaming:
        return articles.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return articles.dropDuplicates([key])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what a stream has now and stop. Output and progress go to the shared folder, so a lost executor only repeats its tasks."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def read_events_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
