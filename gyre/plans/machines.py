"""Queries of caches, retries, downloads, tuning, folds and one-to-many functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gyre.functions import text as X
from gyre.functions import vectors as V
from gyre.plans.registry import query
from gyre.plans.relational import both
from gyre.plans.sources import _HALF
from gyre.plans.telemetry import _events, _folded
from gyre.plans.text import _docs
from gyre.plans.vectors import _COS_Q, _embeddings
from gyre.session import ship
from gyre.streaming.keyed import FifoCache, TieredCache, fold


def _keyed_events(spark, sf_dir):
    """Events with the key that a user asks for in them."""
    return _events(spark, sf_dir).withColumn("asked", (F.col("event_id") % 7).cast("double"))


_FRESH = "len(list_filter(r.held, lambda x: x.k = e.event_id % 7 AND e.s - x.t < 172800)) > 0"
_OTHERS = "list_filter(r.held, lambda x: x.k <> e.event_id % 7)"


@query("st11_fifo_cache", _folded("user_id", "[{'k': event_id % 7, 't': s}] AS held, false AS ok", f"CASE WHEN {_FRESH} THEN r.held ELSE list_append({_OTHERS}[greatest(1, len({_OTHERS}) - 1):], {{'k': e.event_id % 7, 't': e.s}}) END, {_FRESH}", "ok"))
def st11(spark, sf_dir):
    """A cache of three answers for two days, for each user; allowed says whether a request was a hit."""
    return fold(_keyed_events(spark, sf_dir), lambda: FifoCache(3, 172_800.0), "user_id", "s", "event_id", "asked")


_ASKS = "(e.event_id % 7)"
_UP = f"list_append(list_filter(r.upper, lambda x: x <> {_ASKS}), {_ASKS})"
_LOW = f"list_append(list_filter(r.lower, lambda x: x <> {_ASKS}), {_ASKS})"


@query("st10_tiered_cache", _folded("user_id", "[event_id % 7] AS upper, [event_id % 7] AS lower, false AS ok", f"{_UP}[-2:], CASE WHEN list_contains(r.upper, {_ASKS}) THEN r.lower ELSE {_LOW}[-4:] END, list_contains(r.upper, {_ASKS})", "ok"))
def st10(spark, sf_dir):
    """Tiers of two and four entries for each user; allowed says whether the first tier had it."""
    return fold(_keyed_events(spark, sf_dir), lambda: TieredCache(2, 4), "user_id", "s", "event_id", "asked")


both("s1_backoff", """WITH f AS (SELECT user_id, count_if(event_type = 'error') % 6 AS failures FROM {events} GROUP BY user_id)
SELECT user_id, least(4, failures + 1) AS attempts, failures < 4 AS fetched, CAST(2 * (least(4, failures + 1) * (least(4, failures + 1) - 1)) / 2 AS DOUBLE) AS waited FROM f""")
both("s5_download_plan", """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'present' WHEN l.toxic = 1 THEN 'unavailable' ELSE 'download' END AS action FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
both("x10_tuning", """WITH m AS (SELECT event_type, avg(value) AS quality, stddev_pop(value) AS latency, count(*) AS n FROM {events} GROUP BY event_type),
i AS (SELECT event_type, quality < 15 AS poor, latency > 13 AS slow, n % 2 = 0 AS big, n % 3 = 0 AS cold FROM m)
SELECT event_type, CASE WHEN poor THEN least(20 + 5, 50) WHEN slow THEN greatest(20 - 3, 5) ELSE 20 END AS retrieval_top_k, CAST(CASE WHEN poor THEN greatest(0.5 - 0.05, 0.3) ELSE 0.5 END AS DOUBLE) AS score_threshold,
CASE WHEN big THEN greatest(CAST(floor(32 / 2) AS INT), 8) ELSE 32 END AS batch_size, CASE WHEN big THEN greatest(4096 - 1024, 2048) ELSE 4096 END AS context_length, CASE WHEN cold THEN least(50 + 10, 100) ELSE 50 END AS chunk_overlap FROM i""")


@query("x8_ema_fold", "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, k, value AS ema FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, 0.2::DOUBLE * e.value + 0.8::DOUBLE * r.ema FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, round(arg_max(ema, k), 6) AS ema FROM r GROUP BY user_id")
def x8(spark, sf_dir):
    """The last exponential moving average of each user as a sum of weighted values, which needs no order within a task."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).select("user_id", "value", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    weight = F.pow(F.lit(0.8), F.col("n") - F.col("k")) * F.when(F.col("k") == 1, 1.0).otherwise(0.2)
    return e.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))


@query("x7_one_to_many", r"SELECT doc_id, (i - 1)::INT AS place, p[i] AS sentence FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \t\n\r\x0B\x0C')), lambda s: s <> '') AS p FROM documents))")
def x7(spark, sf_dir):
    """A row for each sentence of a document."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence"))


@query("v7_half_precision", f"SELECT a.vec_id, round({_COS_Q}, 5) + 0.0 AS score FROM (SELECT vec_id, {_HALF} AS v FROM embeddings) a JOIN (SELECT vec_id, {_HALF} AS q FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def v7(spark, sf_dir):
    """Cosine of vectors that were rounded to half precision."""
    ship(spark)
    h = _embeddings(spark, sf_dir).select("vec_id", V.to_bytes("embedding", True).alias("h")).select("vec_id", V.from_bytes("h", True).alias("v"))
    pairs = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("q")), "vec_id")
    return pairs.select("vec_id", (F.round(V.cosine(F.col("v"), F.col("q")), 5) + 0.0).alias("score"))
