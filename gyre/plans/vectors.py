"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gyre.functions import vectors as V
from gyre.operators.retrieval import detect_grade, grade_scores, merge_hits, vote_grade
from gyre.plans.registry import query
from gyre.session import table

_VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
_ASKED = f"(SELECT vec_id AS qid, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_COS_Q = _COS.format(a="v", b="q")


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _asked(e):
    """The rows that searches take as queries: qid, qvec."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _pairwise(name, metric, sql, of=lambda score: score):
    """A measure of each query with all rows."""

    @query(name, f"SELECT qid, vec_id, round({sql}, 6) + 0.0 AS x FROM (SELECT vec_id, {_VEC} AS v FROM embeddings), {_ASKED}")
    def run(spark, sf_dir):
        e = _embeddings(spark, sf_dir)
        return V.scores(_asked(e), e, metric).select("qid", "vec_id", (F.round(of(F.col("score")), 6) + 0.0).alias("x"))


_pairwise("v1_cosine", "cosine", _COS_Q)
_pairwise("v3_dot", "ip", "list_dot_product(v, q)", lambda x: -x)
_pairwise("v5_l2", "l2", "list_distance(v, q)")
_pairwise("v6_inner_product", "ip", "-list_dot_product(v, q)")
_pairwise("v9_cosine_distance", "cosine", f"1 - {_COS_Q}", lambda x: 1 - x)
_pairwise("v16_preservation", "cosine", f"least(10.0, greatest(0.0, ({_COS_Q} - 0.5) * 10))", lambda x: F.least(F.lit(10.0), F.greatest(F.lit(0.0), (x - 0.5) * 10)))


@query("v4_normalized", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_dot_product(v, v)), 5) AS l1 FROM (SELECT vec_id, {_VEC} AS v FROM embeddings)")
def v4(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(F.aggregate(V.normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


def _topk_sql(order, score, k=10):
    return f"""WITH q AS (SELECT vec_id AS qid, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, {_VEC} AS v FROM embeddings)
SELECT qid, vec_id, round(s, 6) AS score, rank::INT AS rank FROM (SELECT qid, vec_id, {score} AS s, row_number() OVER (PARTITION BY qid ORDER BY {score} {order}, vec_id) AS rank FROM e, q) WHERE rank <= {k}"""


def _search(metric):
    def run(spark, sf_dir):
        e = _embeddings(spark, sf_dir)
        return V.nearest(_asked(e), e, 10, metric).withColumn("score", F.round("score", 6))

    return run


query("k1_vector_topk", _topk_sql("DESC", _COS_Q))(_search("cosine"))
query("k4_topk_l2", _topk_sql("ASC", "list_distance(v, q)"))(_search("l2"))
query("v8_topk_ip", _topk_sql("ASC", "-list_dot_product(v, q)"))(_search("ip"))


@query("k2_filtered_topk", f"""SELECT qid, vec_id, round(s, 6) AS score, rank::INT AS rank FROM (SELECT qid, vec_id, {_COS_Q} AS s, row_number() OVER (PARTITION BY qid ORDER BY {_COS_Q} DESC, vec_id) AS rank FROM (SELECT vec_id, {_VEC} AS v FROM embeddings WHERE label IN (1, 2)), {_ASKED}) WHERE rank <= 12""")
def k2(spark, sf_dir):
    """The twelve nearest of two labels for each query."""
    e = _embeddings(spark, sf_dir)
    return V.nearest(_asked(e), e.where("label IN (1, 2)"), 12).withColumn("score", F.round("score", 6))


@query("v13_semantic_cache", f"""WITH e AS (SELECT vec_id, text, {_VEC} AS v FROM embeddings LEFT JOIN documents ON doc_id = vec_id), q AS (SELECT vec_id AS qid, text, v AS q FROM e WHERE vec_id % 100 = 0),
same AS (SELECT qid, min(vec_id) AS exact FROM q JOIN e ON e.text = q.text AND vec_id <> qid GROUP BY qid), near AS (SELECT qid, vec_id, {_COS_Q} AS s FROM q, e WHERE vec_id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_COS_Q} DESC, vec_id) = 1)
SELECT qid, coalesce(exact, vec_id) AS vec_id, CASE WHEN exact IS NULL THEN 'semantic' ELSE 'exact' END AS hit, CASE WHEN exact IS NULL THEN round(s, 6) END AS score FROM near LEFT JOIN same USING (qid) WHERE exact IS NOT NULL OR s >= 0.92""")
def v13(spark, sf_dir):
    """What a cache of all other rows answers to each query: the first entry of the same text, else the most similar one from 0.92 on; a miss gives no row.

    The document of the same id stands for the prompt of a vector.
    """
    e = _embeddings(spark, sf_dir)
    q = _asked(e)
    # the two first entries of a text, one of which is another than the query
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(e.select("vec_id"), "vec_id")
    first = F.row_number().over(Window.partitionBy("text").orderBy("vec_id"))
    entries = texts.distinct().withColumn("k", first).where("k <= 2").select("text", F.col("vec_id").alias("entry"))
    same = texts.join(q.select(F.col("qid").alias("vec_id")), "vec_id").join(entries, "text").where("entry <> vec_id")
    exact = same.groupBy(F.col("vec_id").alias("qid")).agg(F.min("entry").alias("exact"))
    # the nearest two, one of which may be the query itself
    near = V.nearest(q, e, 2).where("vec_id <> qid AND score >= 0.92").groupBy("qid").agg(F.min(F.struct("rank", "vec_id", "score")).alias("near"))
    found = exact.join(near, "qid", "full").withColumn("hit", F.when(F.col("exact").isNotNull(), "exact").otherwise("semantic"))
    return found.select("qid", F.coalesce("exact", "near.vec_id").alias("vec_id"), "hit", F.when(F.col("hit") == "semantic", F.round("near.score", 6)).alias("score"))


@query("v14_quantized", """WITH b AS (SELECT vec_id, embedding AS v, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
SELECT vec_id, list_sum(list_transform(v, lambda x: round((x::DOUBLE - lo) / greatest((hi - lo) / 255, 1e-12))::INT))::BIGINT AS total FROM b""")
def v14(spark, sf_dir):
    q = V.quantized(F.col("embedding"))["codes"]
    return _embeddings(spark, sf_dir).select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("v17_estimators", f"""WITH s AS (SELECT qid, label, {_COS_Q} AS s, row_number() OVER (PARTITION BY qid, label ORDER BY {_COS_Q} DESC, vec_id) AS k FROM (SELECT vec_id, label, {_VEC} AS v FROM embeddings), {_ASKED})
SELECT qid, label, round(max(s), 6) AS best, round(avg(s), 6) AS top3 FROM s WHERE k <= 3 GROUP BY qid, label""")
def v17(spark, sf_dir):
    """The best of each label for each query, and the mean of its three best; a task keeps three rows for each."""
    e = _embeddings(spark, sf_dir)
    return V.nearest(_asked(e), e, 3, group="label").groupBy("qid", "label").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("top3"))


@query("v20_objective_match", f"SELECT qid, label, round(avg({_COS_Q}), 6) AS match FROM (SELECT vec_id, label, {_VEC} AS v FROM embeddings), {_ASKED} GROUP BY qid, label")
def v20(spark, sf_dir):
    """The mean of each label's rows for each query, summed in each task first."""
    e = _embeddings(spark, sf_dir)
    return V.scores(_asked(e), e, group="label").groupBy("qid", "label").agg(F.round(F.avg("score"), 6).alias("match"))


@query("v22_batches", "SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS batch FROM embeddings")
def v22(spark, sf_dir):
    """Places within a label by runs of a thousand ids: the rows before a run are counted, those in it ranked."""
    run = F.floor(F.col("vec_id") / 1000)
    e = _embeddings(spark, sf_dir).select("vec_id", "label", run.alias("run"))
    sizes = e.groupBy("label", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("label", "run", F.coalesce(before, F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("label", "run").orderBy("vec_id"))
    return e.withColumn("n", n).join(sizes, ["label", "run"]).select("vec_id", F.floor((F.col("before") + F.col("n") - 1) / 16).alias("batch"))


def _hits(spark, sf_dir):
    """Scored hits with a grade, for a set of questions."""
    e = _embeddings(spark, sf_dir)
    return V.nearest(_asked(e), e, 12).select("qid", F.col("vec_id").alias("pos"), (F.col("vec_id") % 12 + 1).cast("int").alias("grade"), F.round("score", 9).alias("similarity"))


_HITS = f"h AS (SELECT qid, vec_id AS pos, (vec_id % 12 + 1)::INT AS grade, round(s, 9) AS similarity FROM (SELECT qid, vec_id, {_COS_Q} AS s, row_number() OVER (PARTITION BY qid ORDER BY {_COS_Q} DESC, vec_id) AS k FROM (SELECT vec_id, {_VEC} AS v FROM embeddings), (SELECT vec_id AS qid, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0)) WHERE k <= 12)"
_SCORES = _HITS + ", g AS (SELECT qid, grade, sum(similarity) AS score, min(pos) AS first FROM (SELECT *, row_number() OVER (PARTITION BY qid, grade ORDER BY similarity DESC, pos) AS k FROM h WHERE similarity >= 0.1) WHERE k <= 3 GROUP BY qid, grade)"


@query("a5_grade_scores", f"WITH {_SCORES} SELECT qid, grade, round(score, 6) AS score FROM g")
def a5(spark, sf_dir):
    return grade_scores(_hits(spark, sf_dir), floor=0.1).select("qid", "grade", F.round("score", 6).alias("score"))


@query("a6_detect_grade", f"WITH {_SCORES} SELECT qid, grade FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS k FROM g) WHERE k = 1")
def a6(spark, sf_dir):
    return detect_grade(_hits(spark, sf_dir), floor=0.1)


@query("a7_vote_grade", f"""WITH {_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS k, lead(score, 1, 0) OVER (PARTITION BY qid ORDER BY score DESC, first) AS next FROM g),
p AS (SELECT grade, count(*) AS n, max(score - next) AS authority, min(qid) AS first FROM o WHERE k = 1 GROUP BY grade) SELECT 1::INT AS question, grade FROM p ORDER BY n DESC, authority DESC, first LIMIT 1""")
def a7(spark, sf_dir):
    return vote_grade(_hits(spark, sf_dir).withColumn("question", F.lit(1)), floor=0.1)


@query("a8_merge_hits", f"WITH {_HITS} SELECT pos, max(similarity) AS similarity FROM h GROUP BY pos ORDER BY similarity DESC, pos LIMIT 20")
def a8(spark, sf_dir):
    return merge_hits(_hits(spark, sf_dir), ["pos"], 20).select("pos", "similarity")
