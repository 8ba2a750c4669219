"""Checks over events (event_id, ts, user_id, event_type, value).

The batch forms are windows; ``streamed_*`` are the same rules for ``readStream`` frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_rate(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Requests of a user in the window that ends with each request, and whether the limit rejects it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = events.withColumn("_at", micros).withColumn("in_hour", F.count("*").over(w)).drop("_at")
    return out.withColumn("rejected", F.col("in_hour") > limit)


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """Runs of events of a user without a pause longer than ``gap`` seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    s = events.withColumn("_new", F.when(before.isNull() | (pause > gap * 1_000_000), 1).otherwise(0))
    s = s.withColumn("session", F.sum("_new").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"), F.count("*").alias("beats"))


def replay(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def latest_stage(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("progress"))


def streamed_rate(events: DataFrame, window: str, late: str) -> DataFrame:
    """Requests per user and tumbling window, with late data up to ``late``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("tokens"))


def streamed_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Liveness: sessions of beats with a pause below ``gap``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("beats"))

