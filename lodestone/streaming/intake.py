"""Incremental intake of articles, and usage by time, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.readers import ARTICLE


def article_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON articles of a folder, once for each URL that is seen within a day of event time."""
    rows = spark.readStream.schema(ARTICLE).option("multiLine", True).json(folder)
    stamped = rows.withColumn("seen_at", F.coalesce(F.try_to_timestamp("scraped_at"), F.current_timestamp()))
    return stamped.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["url"])


def upsert_stream(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each micro-batch to ``merge``, which must give the same result when repeated."""
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with ``ts`` as a timestamp, and a watermark if they are a stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late) if events.isStreaming else stamped


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, users and values by type and tumbling window; works on streams and tables."""
    timed = _timed(events, late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value")
    ).select(F.col("w.start").alias("window_start"), "event_type", "events", "users", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``(user_id, session_start, session_end, events)``: runs of a user's events without a longer gap."""
    timed = _timed(events, late)
    grouped = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
