"""Sliding request rate on a fetch-log stream (T4): event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rate(stream: DataFrame, key: str = "host", ts: str = "ts", window: str = "60 seconds",
                slide: str = "10 seconds", burst: int = 1, watermark: str = "10 minutes") -> DataFrame:
    """Requests per key and sliding window, with the burst flag; rows later than the watermark are dropped."""
    t = F.col(ts).cast("timestamp")
    s = stream.withColumn("_t", t).withWatermark("_t", watermark)
    g = s.groupBy(F.window("_t", window, slide).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests",
                    (F.col("requests") >= burst).alias("burst"))
