"""Windows, sessions and joins on event time, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, key: str, time: str, width: str, delay: str) -> DataFrame:
    """(key, start, n): events of a key in each window of time; a window is closed when the watermark, delay behind the latest time seen, passes its end.

    Late rows, whose window is closed when they arrive, are left out.
    """
    w = F.window(time, width)
    return events.withWatermark(time, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key with less than gap between them; end is gap after the last."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str) -> DataFrame:
    """Rows of two streams with equal keys, the right one at most within after the left. State older than the watermarks allow is dropped."""
    a, b = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay).withColumnRenamed(key, "_key")
    near = F.expr(f"`{key}` = _key AND `{right_time}` >= `{left_time}` AND `{right_time}` <= `{left_time}` + INTERVAL {within}")
    return a.join(b, near).drop("_key")
