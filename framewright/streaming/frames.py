"""Streaming forms: tumbling windows over events, and sessions of a user with a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of value per window and key; rows later than the watermark are dropped in a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything that is there into a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
