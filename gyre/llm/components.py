"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.session import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b long) -> (node, component): the smallest node that links reach.

    Each step links nodes with the smallest of their neighbourhood, so that the
    links become stars in about log n rounds. Minima are aggregated before the
    shuffle; the joins that follow are on a node, and a hot one is split by the
    adaptive skew join. Nodes without links have no row.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = materialize(edges, "edges")
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: a node's larger neighbours go to its smallest
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = materialize(large, "large")
        # small star: a node's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("x"), F.explode(F.array("hi", "lo")).alias("y")).where("x <> y").select(F.col("x").alias("lo"), F.col("y").alias("hi")).distinct()
        small = materialize(small, "small")
        count, same = small.count(), small.join(edges, ["lo", "hi"], "left_semi").count()
        if count == same == edges.count():
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(small.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
        edges = small
