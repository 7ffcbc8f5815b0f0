"""Evidence for a grade, votes over queries, pooling of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Similarity that a hit needs to count as evidence.
FLOOR = 0.35
TOP = 3


def grade_scores(hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(qid, grade, score, first): the sum of a grade's three best similarities in each query.

    hits: qid, grade, similarity, pos (order of appearance).
    """
    good = hits.where((F.col("similarity") >= floor) & F.col("grade").isNotNull())
    k = F.row_number().over(Window.partitionBy("qid", "grade").orderBy(F.desc("similarity"), "pos"))
    return good.withColumn("k", k).where(F.col("k") <= TOP).groupBy("qid", "grade").agg(F.sum("similarity").alias("score"), F.min("pos").alias("first"))


def detect_grade(hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(qid, grade): the grade with the most evidence, the first seen of equals; queries without evidence have no row."""
    best = F.max_by("grade", F.struct("score", -F.col("first")))
    return grade_scores(hits, floor).groupBy("qid").agg(best.alias("grade"))


def vote_grade(hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(question, grade): over several queries of a question, the grade that most
    propose, then the one with the largest lead over its query's runner-up, then
    the one that the first query proposes."""
    own = hits.select("question", "qid").distinct()
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    lead = grade_scores(hits, floor).withColumns({"k": F.row_number().over(w), "next": F.lead("score", 1, 0.0).over(w)})
    proposed = lead.where("k = 1").join(own, "qid").groupBy("question", "grade").agg(F.count("*").alias("n"), F.max(F.col("score") - F.col("next")).alias("authority"), F.min("qid").alias("first"))
    return proposed.groupBy("question").agg(F.max_by("grade", F.struct("n", "authority", -F.col("first"))).alias("grade"))


def merge_hits(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The best hit of each key, the first seen of equals, best first."""
    best = F.max_by(F.struct("similarity", "pos"), F.struct("similarity", -F.col("pos")))
    own = [k for k in keys if k not in ("similarity", "pos")]
    out = hits.groupBy(*keys).agg(best.alias("b")).select(*own, "b.*")
    return out.orderBy(F.desc("similarity"), "pos").limit(limit)


def reranked(hits: DataFrame, query_col: str, rank_col: str, score: Column, k: int) -> DataFrame:
    """hits with a score and a place, the k best of each query by score, ties by the rank they had.

    Where the score of any of a query's hits is null, as scoring has failed, all
    of them have 0.5 and stay in their order.
    """
    scored = hits.withColumn("score", score)
    failed = F.max(F.col("score").isNull()).over(Window.partitionBy(query_col))
    scored = scored.withColumn("_failed", failed).withColumn("score", F.when(F.col("_failed"), F.lit(0.5)).otherwise(F.col("score"))).drop("_failed")
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), rank_col))
    return scored.withColumn("place", place).where(F.col("place") <= k)
