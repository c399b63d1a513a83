"""Structured Streaming over an event log. The reference has no streams; its append, latest-wins and insert-once rules are offered as such, and windows come with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it comes within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


def latest(events: DataFrame) -> DataFrame:
    """The last value of each user and type; in update mode it is a latest-wins table."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """A user's sessions: runs of events with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, first_id, first_ts, then_id, then_ts): pairs of a user's events of two tables (event_id, ts, user_id), the second up to ``within`` after the first. Batch and stream alike.

    As streams, both sides are held as long as the other may still match: rows later than ``late`` behind their own side's latest time are dropped, and no others. Null users match nobody.
    """
    a = first.select(F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"), "user_id")
    b = then.select(F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"), F.col("user_id").alias("then_user"))
    a, b = (d.withWatermark(c, late) if d.isStreaming else d for d, c in ((a, "first_ts"), (b, "then_ts")))
    met = a.join(b, (F.col("user_id") == F.col("then_user")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}")))
    return met.select("user_id", "first_id", "first_ts", "then_id", "then_ts")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, a window every ``step``; each event is in all windows that hold it. Batch and stream alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")
