"""Gap-and-island clustering on streams: the batch operator's runs as session windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Rows (key, start, end, n): runs of events with gaps of at most `gap`; those later than `late` are dropped.

    `end` is the last event's time. Works on streams in append mode and on tables.
    """
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    window = F.session_window("_at", gap)
    return rows.groupBy(key, window).agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("n")).select(key, "start", "end", "n")


def unique(events: DataFrame, id_column: str, at: str, late: str) -> DataFrame:
    """The first row of every id within the watermark."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    if not events.isStreaming:
        return rows.dropDuplicates([id_column]).drop("_at")
    return rows.withWatermark("_at", late).dropDuplicatesWithinWatermark([id_column]).drop("_at")
