"""An extension of batch change counts: the same totals over a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(events: DataFrame, time: str = "ts", key: str = "event_type", value: str | None = None, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(key, start, commits, lines) by tumbling windows; a row later than ``late`` is dropped."""
    amount = F.lit(1) if value is None else F.col(value)
    w = events.withWatermark(time, late).groupBy(key, F.window(time, window).alias("w"))
    return w.agg(F.count("*").alias("commits"), F.sum(amount).alias("lines")).select(key, F.col("w.start").alias("start"), "commits", "lines")
