"""Joins on time: the last row as of a time, and rows within an interval; both by equal keys and buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(time: Column, width: float) -> Column:
    return F.floor(time / F.lit(float(width))).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, order: str, width: float, name: str = "found") -> DataFrame:
    """left with a struct, name: the columns of the last row of right with the same key at or before the time of each row; null if there is none.

    time is in seconds; of equal times in right the row with the largest order
    counts. Rows without a key or a time find nothing. Both sides are sorted
    together, in buckets of width seconds of a key, so that a hot key is many
    tasks; what the buckets before hold comes from a table with a row for each
    bucket that has rows of right.
    """
    kept = [c for c in right.columns if c != key]
    payload = F.struct(*[F.col(c) for c in kept])
    own = F.struct(*[F.col(c) for c in left.columns])
    null = lambda of, side: F.lit(None).cast(of.select(side).schema[0].dataType)
    sides = ["_key", "_time", "_order", "_left", "_right"]
    a = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(None).cast(right.schema[order].dataType).alias("_order"), own.alias("_left"), null(right, payload).alias("_right"))
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.col(order).alias("_order"), null(left, own).alias("_left"), payload.alias("_right"))
    rows = a.select(*sides).unionByName(b.select(*sides)).withColumn("_bucket", _bucket(F.col("_time"), width))
    # at equal times rows of right stand first
    inside = Window.partitionBy("_key", "_bucket").orderBy("_time", F.col("_left").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_last", F.last("_right", ignorenulls=True).over(inside)).where("_left is not null")
    ends = b.withColumn("_bucket", _bucket(F.col("_time"), width)).groupBy("_key", "_bucket").agg(F.max_by("_right", F.struct("_time", "_order")).alias("_end"))
    # each bucket's end counts until the next bucket that has one
    until = F.lead("_bucket").over(Window.partitionBy("_key").orderBy("_bucket"))
    spans = ends.withColumn("_until", until)
    asking = near.select("_key", "_bucket").distinct().join(spans.select("_key", F.col("_bucket").alias("_from"), "_until", "_end"), "_key").where("_from < _bucket AND (_until IS NULL OR _until >= _bucket)")
    before = asking.select("_key", "_bucket", "_end")
    out = near.join(before, ["_key", "_bucket"], "left")
    return out.select("_left.*", F.coalesce("_last", "_end").alias(name))


def interval_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, time: str, width: float) -> DataFrame:
    """Pairs of rows with equal keys where right's time (seconds) lies from left's start to its end.

    A row of left stands in each bucket of width seconds that its interval
    touches, a row of right in one, so that each pair meets once; a hot key is
    as many keys as it has buckets. Columns of the sides must differ but for the
    key. Rows without a key or a time, and empty intervals, have no pairs.
    """
    touched = F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width)))
    a = left.where(F.col(start) <= F.col(end)).withColumn("_bucket", touched)
    b = right.withColumn("_bucket", _bucket(F.col(time), width))
    return a.join(b, [key, "_bucket"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_bucket")
