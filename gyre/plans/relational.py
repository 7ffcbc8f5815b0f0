"""Relational reporting: filters, joins, aggregations, windows, top-k and set operations over the tables.

The corpus roles: documents are content (grade from the id, medium = lang,
subject = source), labels are validation records, conversations hold messages,
events are telemetry, embeddings are chunks with a label as their content.
Each plan is one declarative statement that Catalyst plans; the same text is
the SQL to check it by, unless the two dialects differ.
"""

from __future__ import annotations

import re

from gyre.plans.registry import query
from gyre.session import table

_CONTENT = "(SELECT doc_id, CAST(doc_id % 12 + 1 AS INT) AS grade, lang AS medium, source AS subject, text, n_chars FROM {documents})"


def both(name: str, sql: str, duck: str | None = None) -> None:
    """Register a statement whose tables stand in braces."""
    sql = sql.replace("{content}", _CONTENT)
    duck = (duck or sql).replace("{content}", _CONTENT)
    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark, sf_dir):
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    query(name, re.sub(r"\{(\w+)\}", r"\1", duck))(run)


# --- filters and projections
both("f1_json_path", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) >= 50",
     "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM {events} WHERE CAST(props ->> '$.k' AS INT) >= 50")
both("f2_snippet", "SELECT doc_id, left(text, 80) AS snippet FROM {documents}")
both("f3_dynamic_filter", "SELECT doc_id, grade, subject, medium FROM {content} c WHERE grade = 6 AND lower(subject) LIKE '%src1%' AND medium = 'en'")
both("f4_membership", "SELECT doc_id, medium FROM {content} c WHERE medium IN ('fr', 'de')")
both("f5_catalog_select", "SELECT doc_id, grade, medium FROM {content} c WHERE grade IN (6, 7, 8) AND medium IN ('en', 'es')")
both("f7_finite_vectors", "SELECT vec_id FROM {embeddings} WHERE NOT exists(embedding, x -> isnan(x) OR x = float('inf') OR x = float('-inf'))",
     "SELECT vec_id FROM {embeddings} WHERE NOT coalesce(list_bool_or(list_transform(embedding, lambda x: NOT isfinite(x))), false)")
both("f11_minimum_length", "SELECT doc_id, n_chars FROM {documents} WHERE length(text) >= 120")
both("f13_row_security", "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = 7 OR c_nationkey IS NULL")
both("f14_review_flag", """SELECT doc_id, CASE WHEN toxic = 1 THEN 'safety' WHEN quality = 0 THEN 'low_confidence' END AS reason FROM {labels}""")
both("f15_grade_range", "SELECT doc_id, CASE WHEN subject = 'src1' THEN 0 ELSE 1 END AS preference FROM {content} c WHERE subject IN ('src1', 'src2') AND 6 BETWEEN grade - 2 AND grade + 2")
both("f16_region_lookup", "SELECT d.doc_id, coalesce(r.region, 'general') AS region FROM {documents} d LEFT JOIN (VALUES ('fr', 'west'), ('de', 'north')) AS r(lang, region) ON d.lang = r.lang")
both("f19_grade_band", """SELECT c.doc_id, coalesce(b.band, '6-8') AS band FROM {content} c
LEFT JOIN (VALUES (1, 3, '1-3'), (4, 5, '4-5'), (6, 8, '6-8'), (9, 10, '9-10'), (11, 12, '11-12')) AS b(lo, hi, band) ON c.grade BETWEEN b.lo AND b.hi""")
both("f21_status_case", "SELECT event_id, CASE WHEN value >= 50 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'ok' END AS status FROM {events}")
both("f22_title_contains", "SELECT p_partkey, p_name FROM {part} WHERE instr(lower(p_name), lower('Ring')) > 0")

# --- joins
both("j1_left_join", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
both("j2_star_join", """SELECT l.l_orderkey, l.l_linenumber, o.o_orderdate, c.c_name FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 45""")
both("j3_inner_join", "SELECT e.vec_id, d.source FROM {embeddings} e JOIN {documents} d ON e.vec_id = d.doc_id")
both("j4_late_join", """WITH nearest AS (SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
SELECT n.o_orderkey, n.o_totalprice, c.c_name FROM nearest n JOIN {customer} c ON n.o_custkey = c.c_custkey""")
both("j5_conversation_counts", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
both("j6_semi_join", "SELECT doc_id FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
both("j7_pending_anti_join", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 25")
both("j8_standard_lookup", """SELECT c.doc_id, coalesce(s.score, 0.0) AS score, coalesce(s.score >= 0.7, false) AS passed FROM {content} c
LEFT JOIN (VALUES (6, 'src1', CAST(0.85 AS DOUBLE)), (7, 'src2', CAST(0.55 AS DOUBLE))) AS s(grade, subject, score) ON c.grade = s.grade AND c.subject = s.subject""",
     """SELECT c.doc_id, coalesce(s.score, 0.0::DOUBLE) AS score, coalesce(s.score >= 0.7, false) AS passed FROM {content} c
LEFT JOIN (VALUES (6, 'src1', CAST(0.85 AS DOUBLE)), (7, 'src2', CAST(0.55 AS DOUBLE))) AS s(grade, subject, score) ON c.grade = s.grade AND c.subject = s.subject""")
both("j9_case_insensitive_lookup", "SELECT p.p_partkey, s.w FROM {part} p JOIN (VALUES ('economy', 1), ('standard', 2)) AS s(kind, w) ON lower(p.p_type) = s.kind")
both("j13_feedback_join", "SELECT e.user_id, round(avg(o.o_totalprice), 4) AS price FROM {events} e JOIN {orders} o ON e.event_id = o.o_orderkey WHERE e.value >= 4 AND e.event_type = 'click' GROUP BY e.user_id")
both("j14_hit_miss", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS hit FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id")
both("j16_scalar_subquery", "SELECT r_name, (SELECT count(*) FROM {nation} n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM {region} r")
both("j17_bigram_next", """WITH s AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a, b, c, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY a, b, c""")
both("j18_full_outer", "SELECT coalesce(d.doc_id, e.vec_id) AS id, d.lang, e.label FROM {documents} d FULL OUTER JOIN {embeddings} e ON d.doc_id = e.vec_id + 100")

# --- aggregations
both("a1_library_rollup", "SELECT c.grade, c.medium, c.subject, count(DISTINCT c.doc_id) AS documents, count(l.quality) AS chunks FROM {content} c LEFT JOIN {labels} l ON l.doc_id = c.doc_id GROUP BY c.grade, c.medium, c.subject")
both("a2_grand_totals", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS languages, array_join(sort_array(collect_set(lang)), ',') AS names FROM {documents}",
     "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS languages, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM {documents}")
both("a3_embedding_stats", "SELECT count(*) AS embeddings, count(DISTINCT label) AS documents FROM {embeddings}")
both("a4_messages_per_conversation", "SELECT conv_id, count(text) AS n FROM {conversations} GROUP BY conv_id")
both("a9_context_string", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '\\n') AS context FROM {conversations} GROUP BY conv_id",
     "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM {conversations} GROUP BY conv_id")
both("a10_validation_summary", "SELECT d.source, count(*) AS total, count_if(l.quality = 1) AS passed, count_if(l.quality = 0) AS failed, round(avg(l.quality), 6) AS mean_score, bool_and(l.quality = 1) AS all_passed FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.source")
both("a11_distinct_suggestions", "SELECT user_id, array_join(sort_array(collect_set(event_type)), ',') AS kinds FROM {events} GROUP BY user_id", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM {events} GROUP BY user_id")
both("a12_counts_by_status", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
both("a13_weighted_mean", "SELECT l_returnflag, round(coalesce(sum(l_extendedprice * l_quantity * (1 - l_discount)) / nullif(sum(l_quantity * (1 - l_discount)), 0), 7.0), 4) AS score FROM {lineitem} GROUP BY l_returnflag")
both("a14_top3_weighted", """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders})
SELECT o_custkey, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 4) AS alignment FROM r WHERE k <= 3 GROUP BY o_custkey""")
both("a16_linear_confidence", "SELECT l_orderkey, l_linenumber, round(0.3 * l_discount + 0.3 * l_tax + 0.2 * l_quantity + 0.2, 6) AS overall FROM {lineitem}")
both("a17_retrieval_confidence", "SELECT user_id, round(least(1.0, coalesce(avg(CASE WHEN value >= 20 THEN value / 100 END), 0.5) + least(0.1 * count(CASE WHEN value >= 20 THEN 1 END), 0.2)), 6) AS confidence FROM {events} GROUP BY user_id")
both("a18_latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM {events})
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95, round(percentile(value, 0.99), 6) AS p99 FROM r WHERE k <= 1000 GROUP BY event_type""",
     """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM {events})
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM r WHERE k <= 1000 GROUP BY event_type""")
# counts of whole values say where the rank lies, so that the rows of one whole value are ranked
both("a19_nearest_rank_p95", """WITH b AS (SELECT event_type, floor(value) AS whole, count(*) AS n FROM {events} GROUP BY 1, 2),
c AS (SELECT event_type, whole, n, sum(n) OVER (PARTITION BY event_type ORDER BY whole) - n AS before, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
t AS (SELECT event_type, whole, CAST(floor(0.95 * total) AS BIGINT) + 1 - before AS k FROM c WHERE before < floor(0.95 * total) + 1 AND floor(0.95 * total) + 1 <= before + n),
r AS (SELECT e.event_type, e.value, t.k, row_number() OVER (PARTITION BY e.event_type ORDER BY e.value, e.event_id) AS place FROM {events} e JOIN t ON t.event_type = e.event_type AND floor(e.value) = t.whole)
SELECT event_type, value AS p95 FROM r WHERE place = k""",
     """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
SELECT event_type, value AS p95 FROM r WHERE k = CAST(floor(0.95 * n) AS BIGINT) + 1""")
both("a20_benchmark_stats", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, round(stddev_samp(value), 6) AS sd FROM {events} GROUP BY event_type")
both("a21_population_sd", "SELECT label, round(avg(vec_id), 6) AS mean, round(stddev_pop(vec_id), 4) AS sd FROM {embeddings} GROUP BY label")
both("a22_low_percentile", "SELECT round(percentile(value, 0.01), 6) AS p1, min(value) AS lo FROM {events}", "SELECT round(quantile_cont(value, 0.01), 6) AS p1, min(value) AS lo FROM {events}")
both("a23_hit_rate", "SELECT user_id, round(coalesce(CAST(count_if(event_type = 'click') AS DOUBLE) / nullif(count_if(event_type IN ('click', 'view')), 0), 0), 6) AS rate FROM {events} GROUP BY user_id")
both("a24_occupancy", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM {documents} GROUP BY source")
both("a25_feedback_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS rating FROM {events} GROUP BY GROUPING SETS ((event_type), ())")
both("a26_parameter_means", "SELECT key, round(avg(x), 6) AS mean FROM (SELECT 'discount' AS key, l_discount AS x FROM {lineitem} UNION ALL SELECT 'tax', l_tax FROM {lineitem}) u GROUP BY key")
both("a27_learning_stats", "SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), 6) AS improved, count_if(toxic = 1) AS flagged FROM {labels}")
both("a28_hot_resources", "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
both("a29_transition_probability", """WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM {events}), c AS (SELECT a, b, count(*) AS n FROM s WHERE a IS NOT NULL GROUP BY a, b)
SELECT a, b, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY a), 6) AS p FROM c""")
both("a30_mean_reciprocal_rank", """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {events}), f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN k END) AS k FROM r GROUP BY user_id)
SELECT count(*) AS n, count_if(k = 1) AS first, round(avg(coalesce(CAST(1.0 AS DOUBLE) / k, 0)), 6) AS mrr FROM f""")
both("a31_wilson_interval", """WITH c AS (SELECT source, count(*) AS n, CAST(sum(quality) AS DOUBLE) AS k FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY source)
SELECT source, round(greatest(0.0, (k / n + 1.9208 / n - 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n)), 6) AS lo, round(least(1.0, (k / n + 1.9208 / n + 1.96 * sqrt((k / n * (1 - k / n) + 0.9604 / n) / n)) / (1 + 3.8416 / n)), 6) AS hi FROM c""")
both("a32_threshold_sweep", """WITH t AS (SELECT explode(sequence(0, 100)) AS step), s AS (SELECT step, (avg(CASE WHEN toxic = 0 THEN CASE WHEN n_chars >= step * 50 THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN toxic = 1 THEN CASE WHEN n_chars < step * 50 THEN 1e0 ELSE 0e0 END END)) / 2 AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id CROSS JOIN t GROUP BY step)
SELECT step, round(score, 6) AS score FROM s""",
     """WITH t AS (SELECT unnest(range(0, 101)) AS step), s AS (SELECT step, (avg(CASE WHEN toxic = 0 THEN CASE WHEN n_chars >= step * 50 THEN 1e0 ELSE 0e0 END END) + avg(CASE WHEN toxic = 1 THEN CASE WHEN n_chars < step * 50 THEN 1e0 ELSE 0e0 END END)) / 2 AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id CROSS JOIN t GROUP BY step)
SELECT step::INT AS step, round(score, 6) AS score FROM s""")
both("a33_age_buckets", """SELECT CASE WHEN d < 1 THEN 'today' WHEN d < 2 THEN 'yesterday' WHEN d < 7 THEN '7 days' WHEN d < 30 THEN '30 days' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT floor((1706572800 - unix_timestamp(CAST(ts AS timestamp))) / 86400) AS d FROM {events}) x GROUP BY 1""",
     """SELECT CASE WHEN d < 1 THEN 'today' WHEN d < 2 THEN 'yesterday' WHEN d < 7 THEN '7 days' WHEN d < 30 THEN '30 days' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT floor((1706572800 - floor(epoch(ts))) / 86400) AS d FROM {events}) x GROUP BY 1""")
both("a34_books_by_grade", "SELECT grade, subject, CAST(floor(doc_id / 1000) AS BIGINT) AS run, array_join(transform(array_sort(collect_list(doc_id)), x -> CAST(x AS STRING)), ',') AS ids FROM {content} c GROUP BY grade, subject, floor(doc_id / 1000)",
     "SELECT grade, subject, (doc_id // 1000)::BIGINT AS run, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM {content} c GROUP BY grade, subject, doc_id // 1000")
both("a35_run_statistics", "SELECT count(*) AS chapters, count_if(n_chars >= 120) AS done, count_if(n_chars < 120) AS skipped, CAST(sum(ceil(n_chars / 1000.0)) AS BIGINT) AS chunks FROM {documents}")
both("a38_token_totals", "SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS completion FROM {conversations} GROUP BY conv_id")
both("a39_distinct_by_json", "SELECT count(DISTINCT get_json_object(props, '$.k')) AS n FROM {events}", "SELECT count(DISTINCT props ->> '$.k') AS n FROM {events}")
both("a40_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
both("a41_non_finite_count", "SELECT count_if(exists(embedding, x -> isnan(x))) AS n FROM {embeddings}", "SELECT count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x)))) AS n FROM {embeddings}")
both("a42_stage_latency", "SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type, date_trunc('day', ts)")

# --- windows
both("w2_runner_up_gap", """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, lead(o_totalprice, 1, 0.0) OVER w AS next, row_number() OVER w AS k FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, round(o_totalprice - next, 4) AS gap FROM s WHERE k = 1""")
both("w3_top_k_per_row", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}) x WHERE k <= 2")
both("w5_last_n", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k <= 10 GROUP BY user_id")
both("w6_moving_average", """WITH s AS (SELECT user_id, array_sort(collect_list(struct(ts, event_id, value))) AS v FROM {events} GROUP BY user_id)
SELECT user_id, round(aggregate(slice(v, 2, greatest(1, size(v))), v[0].value, (acc, x) -> 0.2D * x.value + 0.8D * acc), 6) AS ema FROM s""",
     """WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM {events} GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda acc, x: 0.2::DOUBLE * x + 0.8::DOUBLE * acc), 6) AS ema FROM s""")
# an event counts in its own hour and in the next one, so that an hour is a unit of work
both("w7_trailing_rate", """WITH e AS (SELECT event_id, event_type, unix_timestamp(CAST(ts AS timestamp)) AS s FROM {events}), h AS (SELECT event_id, event_type, s, explode(array(0, 1)) AS later FROM e),
w AS (SELECT event_id, later, count(*) OVER (PARTITION BY event_type, floor(s / 3600) + later ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM h)
SELECT event_id, n FROM w WHERE later = 0""",
     "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM {events}")
both("w8_recency", "SELECT conv_id, turn, round(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY conv_id), 6) AS recency FROM {conversations}")
both("w9_token_budget", """WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER w AS used, row_number() OVER w AS k FROM {conversations} WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn FROM s WHERE used <= 2000 OR k <= 2""")
both("w10_previous_item", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}")
both("w11_first_appearance", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents}) x WHERE k = 1")
both("w12_first_hit_rank", "SELECT user_id, min(CASE WHEN event_type = 'error' THEN k END) AS rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM {events}) x GROUP BY user_id")
both("w13_baseline_drop", """WITH d AS (SELECT date_trunc('day', ts) AS day, avg(value) AS m FROM {events} GROUP BY 1), f AS (SELECT day, m, first_value(m) OVER (ORDER BY day) AS base FROM d) SELECT day, m < 0.9 * base AS rollback FROM f""")
both("w14_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile FROM {customer}")

# --- sort, limit, top-k
both("k7_history", "SELECT conv_id, turn, text FROM {conversations} ORDER BY conv_id DESC, turn DESC LIMIT 50")
both("k8_messages_in_order", "SELECT conv_id, turn, role FROM {conversations} WHERE conv_id = 3 ORDER BY turn")
both("k9_pagination", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
both("k10_multi_key_sort", "SELECT doc_id, grade, medium FROM {content} c ORDER BY grade, medium, doc_id")
both("k12_top_sources", "SELECT source, count(*) AS n FROM {documents} GROUP BY source ORDER BY n DESC, source LIMIT 5")
both("k13_priority_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM {orders}")
both("k14_topk_per_window", """WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2)
SELECT hour, event_type, n FROM (SELECT hour, event_type, n, row_number() OVER (PARTITION BY hour ORDER BY n DESC, event_type) AS k FROM c) x WHERE k <= 3""")
both("k15_sorted_means", "SELECT event_type, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type ORDER BY mean")

# --- set operations
both("u1_union", "SELECT doc_id FROM {labels} WHERE toxic = 1 UNION SELECT doc_id FROM {documents} WHERE lang = 'fr'")
both("u2_difference", "SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id FROM {documents} d ANTI JOIN {labels} l ON d.doc_id = l.doc_id")
both("u4_pooling", """WITH p AS (SELECT p_partkey AS id, p_retailprice AS s FROM {part} UNION ALL SELECT l_partkey, l_extendedprice / l_quantity FROM {lineitem}) SELECT id, round(max(s), 4) AS best FROM p GROUP BY id ORDER BY best DESC, id LIMIT 50""")
both("u5_accumulate_distinct", "SELECT id, min(round) AS round FROM (SELECT doc_id AS id, 1 AS round FROM {labels} UNION ALL SELECT doc_id, 2 FROM {documents} WHERE lang = 'en' UNION ALL SELECT doc_id, 3 FROM {documents}) x GROUP BY id")
both("u6_distinct", "SELECT DISTINCT source, lang FROM {documents}")
both("u7_edition_choice", """WITH r AS (SELECT doc_id, grade, subject, medium, row_number() OVER (PARTITION BY grade, subject ORDER BY CASE medium WHEN 'en' THEN 0 ELSE 1 END, doc_id) AS k FROM {content} c WHERE medium IN ('en', 'fr')) SELECT doc_id, grade, subject FROM r WHERE k = 1""")
both("u8_collapse_duplicates", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM {documents} GROUP BY md5(text)")
both("u9_fan_out", "SELECT d.doc_id, x.first FROM {documents} d JOIN (SELECT text, min(doc_id) AS first FROM {documents} GROUP BY text) x ON d.text = x.text")
