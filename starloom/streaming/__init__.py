"""Event streams. Catalogue queries are batch; this covers the append of usage logs as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; late rows are taken up to the watermark. Works on batches as well."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
