"""Event-time windows over a table or a live stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, keys: list[str], time: str, aggregates: list[Column], width: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """(keys, window_start, window_end, aggregates) of tumbling windows, or sliding ones with ``slide``.

    On a stream ``lateness`` sets the watermark: a window is given out, and its state
    dropped, once the latest time seen is past its end by that much; rows later than
    that are left out. On a table it has no effect. Rows without a time are in no
    window.
    """
    if lateness:
        events = events.withWatermark(time, lateness)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(window.alias("w"), *keys).agg(*aggregates).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[F.col(c) for c in _names(events, keys, aggregates)])


def _names(events: DataFrame, keys: list[str], aggregates: list[Column]) -> list[str]:
    return events.groupBy(*keys).agg(*aggregates).columns[len(keys) :]


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, lateness: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n): runs of events less than ``gap`` apart."""
    if lateness:
        events = events.withWatermark(time, lateness)
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
