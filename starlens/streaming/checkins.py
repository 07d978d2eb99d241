"""Check-ins per time window on a stream, with a watermark for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_checkins(events: DataFrame, ts_col: str = "ts", key_cols=(), window: str = "1 hour",
                      watermark: str = "2 hours") -> DataFrame:
    """Counts per (window[, keys]).  In append mode a window is emitted once
    the watermark passes its end; events later than the watermark are
    dropped, which bounds the state kept per key."""
    return (events.withWatermark(ts_col, watermark)
            .groupBy(F.window(F.col(ts_col), window).alias("w"), *key_cols)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *key_cols, "n"))


def start_windowed_checkins(events: DataFrame, query_name: str, checkpoint: str, **kw):
    """Start :func:`windowed_checkins` into an in-memory table (tests, notebooks);
    production code points ``writeStream`` at a table sink instead."""
    out = windowed_checkins(events, **kw)
    return (out.writeStream.outputMode("append").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
