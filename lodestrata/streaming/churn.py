"""Churn over a stream of commits: sliding windows with a watermark, and bursts.

The operators of a batch don't need them; they serve a log that never ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(entries: DataFrame, window: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """file_id, window, churn, commits (approximate) of entries with a timestamp ts."""
    return entries.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "file_id").agg(
        F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.approx_count_distinct("commit_id").alias("commits")
    )


def bursts(entries: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """author, session window, entries: runs of work without a longer gap."""
    return entries.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "author").agg(F.count("*").alias("entries"))
