"""Event-time windows over a stream of box or response records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(records: DataFrame, value: str, length: str = "6 seconds",
                  slide: str = "2 seconds", lateness: str = "10 seconds",
                  key: str = "scene", ts: str = "ts") -> DataFrame:
    """(key, start, end, n, mean, max) per sliding window; late records are dropped.

    The event-time form of the frame windows: windows are cut by the clock, so
    unlike those they do not close up where frames are missing.
    """
    win = F.window(F.col(ts), length, slide).alias("w")
    records = records.withColumn(ts, F.col(ts).cast("timestamp"))
    return (records.withWatermark(ts, lateness).groupBy(key, win)
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"),
                 F.max(value).alias("max_value"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
                    "mean_value", "max_value"))
