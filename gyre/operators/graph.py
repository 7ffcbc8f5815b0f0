"""Entity graphs as two DataFrames, nodes (key, type) and edges (source, target, relation, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.session import materialize


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """(key, type) of mentions (name, type, pos): names lower-cased and trimmed, the first type of each stays."""
    return mentions.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by("type", "pos").alias("type"))


def upsert_edges(mentions: DataFrame) -> DataFrame:
    """(source, target, relation, weight) of mentions with pos: the last write of an edge wins."""
    last = F.max_by(F.struct("relation", "weight"), "pos")
    return mentions.groupBy(F.lower(F.trim("source")).alias("source"), F.lower(F.trim("target")).alias("target")).agg(last.alias("e")).select("source", "target", "e.*")


def ego_nodes(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(key, distance): what out-edges reach from start (key) in at most depth steps. Each step is a join with the frontier alone."""
    found = start.select("key").distinct().withColumn("distance", F.lit(0))
    frontier = found.select("key")
    for step in range(1, depth + 1):
        reached = edges.join(frontier, edges["source"] == frontier["key"]).select(F.col("target").alias("key")).distinct()
        new = materialize(reached.join(found.select("key"), "key", "left_anti"), "frontier")
        found = materialize(found.unionByName(new.withColumn("distance", F.lit(step))), "ego")
        frontier = new
    return found


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes (key)."""
    keys = nodes.select("key").distinct()
    return edges.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two tables under path, in place of what was there."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that write_graph wrote."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def titled(name: Column) -> Column:
    """Each run of letters with a capital."""
    runs = F.regexp_extract_all(name, F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), "")


def graph_context(edges: DataFrame, entities: DataFrame, depth: int = 2) -> DataFrame:
    """(line): a line for each edge between nodes that entities (key) reach in at most depth steps; none for entities that the graph doesn't have."""
    near = induced_edges(edges, ego_nodes(edges, entities, depth))
    return near.select(F.concat(F.lit("- "), titled(F.col("source")), F.lit(" is "), F.coalesce("relation", F.lit("related to")), F.lit(" "), titled(F.col("target"))).alias("line")).distinct()
