"""Episodes on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_episodes(events: DataFrame, key: str, ts: str = "ts", gap: str = "48 hours", late: str = "7 days", value: str | None = None) -> DataFrame:
    """One row per key and session: events closer than ``gap`` belong together. Works on streams and on tables.

    On a stream the watermark closes a session once it is ``late`` behind; session state is per key and
    holds only the open windows' aggregates.
    """
    e = events.withWatermark(ts, late) if events.isStreaming else events
    g = e.groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
    aggs = [F.count(F.lit(1)).alias("events")] + ([F.sum(value).alias("amount")] if value else [])
    return g.agg(*aggs).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", *(["amount"] if value else []))
