"""The annualising aggregate over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(events: DataFrame, time: str, key: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean and count by key and tumbling window; events later than the watermark are dropped. Batch frames give the same rows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    got = rows.groupBy(F.window(time, window).alias("w"), F.col(key).alias("indicator")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return got.select("indicator", F.col("w.start").alias("start"), "value", "n")
