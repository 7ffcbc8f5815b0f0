"""Queries over event streams, keyed state, entity graphs, and arithmetic on times and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyre.operators.graph import ego_nodes, induced_edges, upsert_edges, upsert_entities
from gyre.plans.registry import query
from gyre.plans.relational import both
from gyre.session import table
from gyre.streaming.keyed import CircuitBreaker, Cooldown, SlidingLog, TokenBucket, fold


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"s": F.unix_micros("ts") / 1e6, "failed": (F.col("event_type") == "error").cast("double")})


both("st1_counter_rate", "SELECT event_type, w.start AS start, round(n / 300e0, 6) AS rate FROM (SELECT event_type, window(CAST(ts AS timestamp), '5 minutes') AS w, count(*) AS n FROM {events} GROUP BY 1, 2) x",
     "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS start, round(count(*) / 300.0, 6) AS rate FROM {events} GROUP BY 1, 2")
both("st2_histogram_quantile", """WITH b AS (SELECT event_type, ceil(value / 10) * 10 AS le, count(*) AS n FROM {events} GROUP BY 1, 2), c AS (SELECT event_type, le, n, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
q AS (SELECT event_type, le, n, cum, total, row_number() OVER (PARTITION BY event_type ORDER BY le) AS k FROM c WHERE cum >= 0.95e0 * total)
SELECT event_type, round(le - 10 + 10 * (0.95e0 * total - (cum - n)) / n, 4) AS p95 FROM q WHERE k = 1""")
both("st3_hold_down", """WITH m AS (SELECT date_trunc('hour', ts) AS h, avg(value) > 25 AS bad FROM {events} GROUP BY 1), g AS (SELECT h, bad, row_number() OVER (ORDER BY h) - row_number() OVER (PARTITION BY bad ORDER BY h) AS island FROM m)
SELECT min(h) AS since, count(*) AS hours FROM g WHERE bad GROUP BY island HAVING count(*) >= 3""")
both("st9_coalesced", """WITH s AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, event_id FROM {events})
SELECT event_id FROM s WHERE before IS NULL OR unix_timestamp(CAST(ts AS timestamp)) - unix_timestamp(CAST(before AS timestamp)) >= 3600""",
     """WITH s AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, event_id FROM {events})
SELECT event_id FROM s WHERE before IS NULL OR floor(epoch(ts)) - floor(epoch(before)) >= 3600""")
both("st13_failure_ledger", """WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS ok FROM {events} GROUP BY user_id)
SELECT e.user_id, count_if(e.event_type = 'error' AND (l.ok IS NULL OR e.ts > l.ok)) AS failures, count_if(e.event_type = 'error' AND (l.ok IS NULL OR e.ts > l.ok)) >= 3 AS dead FROM {events} e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id""")
both("st22_review_status", "SELECT status, count(*) AS n FROM (SELECT user_id, max_by(event_type, struct(ts, event_id)) AS status FROM {events} GROUP BY user_id) x GROUP BY status",
     "SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM {events} GROUP BY user_id) x GROUP BY status")
both("st26_sessions", """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN unix_timestamp(CAST(ts AS timestamp)) - unix_timestamp(CAST(lag(ts) OVER w AS timestamp)) < 1800 THEN 0 ELSE 1 END AS new FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions FROM s GROUP BY user_id""",
     """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) < 1800 THEN 0 ELSE 1 END AS new FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, sum(new)::BIGINT AS sessions FROM s GROUP BY user_id""")


def _folded(key, start, step, allowed, where="true", names="tokens, last"):
    """A machine as SQL: its state goes from an event of a key to the next. start and step give the state's columns for the event in e; r is the state before."""
    return f"""WITH RECURSIVE e AS (SELECT {key}, event_id, epoch_us(ts) / 1e6::DOUBLE AS s, event_type = 'error' AS failed, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM events WHERE {where}),
r AS (SELECT e.{key}, e.event_id, e.k, {start} FROM e WHERE k = 1 UNION ALL SELECT e.{key}, e.event_id, e.k, {step} FROM r JOIN e ON e.{key} = r.{key} AND e.k = r.k + 1)
SELECT {key}, event_id, {allowed} AS allowed FROM r"""


# tokens is what is there before the event takes one
_REFILL = "least(15.0::DOUBLE, (r.tokens - (r.tokens >= 1)::INT) + (e.s - r.last) * 10 / 86400.0::DOUBLE)"


@query("st4_token_bucket", _folded("user_id", "15.0::DOUBLE AS tokens, s AS last", f"{_REFILL}, e.s", "tokens >= 1"))
def st4(spark, sf_dir):
    return fold(_events(spark, sf_dir), lambda: TokenBucket(10, 86400.0), "user_id", "s", "event_id", "failed")


_LIVE = "list_filter(r.granted, lambda t: t > e.s - 86400.0::DOUBLE)"


@query("st6_sliding_log", _folded("user_id", "[s] AS granted, true AS ok", f"CASE WHEN len({_LIVE}) >= 3 THEN {_LIVE} ELSE list_append({_LIVE}, e.s) END, len({_LIVE}) < 3", "ok"))
def st6(spark, sf_dir):
    return fold(_events(spark, sf_dir), lambda: SlidingLog(3, 86400.0), "user_id", "s", "event_id", "failed")


def _breaker():
    """The circuit breaker's state after an event, from that before (st, f, n, since, tried)."""
    entered = "CASE WHEN r.st = 'open' AND e.s - r.since >= 86400 THEN 'half' ELSE r.st END"
    turned = "r.st = 'open' AND e.s - r.since >= 86400"
    denied = "((r.st = 'open' AND e.s - r.since < 86400) OR (r.st = 'half' AND r.tried >= 3))"
    tried = f"CASE WHEN {turned} THEN 0 WHEN r.st = 'half' AND r.tried < 3 THEN r.tried + 1 ELSE r.tried END"
    opens = f"NOT {denied} AND e.failed AND ({entered} = 'half' OR r.f + 1 >= 5)"
    closes = f"NOT {denied} AND NOT e.failed AND {entered} = 'half' AND r.n + 1 >= 2"
    st = f"CASE WHEN {denied} THEN r.st WHEN {opens} THEN 'open' WHEN {closes} THEN 'closed' ELSE {entered} END"
    f = f"CASE WHEN {denied} THEN r.f WHEN e.failed THEN r.f + 1 WHEN {closes} THEN 0 ELSE r.f END"
    n = f"CASE WHEN {denied} THEN r.n WHEN {opens} THEN 0 WHEN e.failed THEN r.n ELSE r.n + 1 END"
    return f"{st}, {f}, {n}, CASE WHEN {opens} THEN e.s ELSE r.since END, {tried}, NOT {denied}"


@query("st7_circuit_breaker", _folded("user_id", "'closed' AS st, failed::INT AS f, (NOT failed)::INT AS n, 0.0::DOUBLE AS since, 0 AS tried, true AS ok", _breaker(), "ok"))
def st7(spark, sf_dir):
    return fold(_events(spark, sf_dir), lambda: CircuitBreaker(timeout=86400.0), "user_id", "s", "event_id", "failed")


@query("st21_alert_cooldown", _folded("user_id", "s AS last, true AS ok", "CASE WHEN e.s - r.last < 86400 THEN r.last ELSE e.s END, e.s - r.last >= 86400", "ok", "value > 40"))
def st21(spark, sf_dir):
    return fold(_events(spark, sf_dir).where("value > 40"), lambda: Cooldown(86400.0), "user_id", "s", "event_id", "failed")


both("m1_age_days", "SELECT event_id, floor((1706572800 - unix_timestamp(CAST(ts AS timestamp))) / 86400) AS days FROM {events}", "SELECT event_id, floor((1706572800 - floor(epoch(ts))) / 86400)::BIGINT AS days FROM {events}")
both("m2_ttl_expired", "SELECT event_id FROM {events} WHERE ts < timestamp_ntz '2024-01-10 00:00:00'", "SELECT event_id FROM {events} WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
both("m3_adaptive_ttl", "SELECT user_id, least(CAST(floor(300 * (1 + log2(count(*)))) AS BIGINT), 3600) AS ttl FROM {events} GROUP BY user_id")
both("m5_iso_time", "SELECT event_id, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") AS iso FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM {events}")
both("m9_json_path", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, props ->> '$.k' AS k FROM {events}")
both("m13_queue_forecast", "SELECT event_type, round(count(*) / 86400e0 * avg(value), 6) AS length FROM {events} GROUP BY event_type")
both("m16_cost_estimate", "SELECT doc_id, CAST(ceil(n_chars / 4e0) AS BIGINT) AS tokens FROM {documents}", "SELECT doc_id, ceil(n_chars / 4.0)::BIGINT AS tokens FROM {documents}")


@query("m14_ab_assignment", """WITH p AS (SELECT c_custkey, ('0x' || substr(md5('experiment:' || c_custkey), 1, 8))::BIGINT % 10000 / 10000.0::DOUBLE AS place FROM customer) SELECT c_custkey, CASE WHEN place < 0.3 THEN 'a' WHEN place < 0.6 THEN 'b' ELSE 'control' END AS version FROM p""")
def m14(spark, sf_dir):
    """The same customer gets the same version in every run and system: a place by a digest of its key."""
    digest = F.md5(F.concat(F.lit("experiment:"), F.col("c_custkey").cast("string")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000 / 10000
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(place < 0.3, "a").when(place < 0.6, "b").otherwise("control").alias("version"))


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("in").alias("relation"), F.lit(1.0).alias("weight"), F.col("n_nationkey").alias("pos"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), F.concat(F.lit("NATION_"), "s_nationkey").alias("target"), F.lit("from").alias("relation"), F.lit(0.5).alias("weight"), F.col("s_suppkey").cast("int").alias("pos"))
    return upsert_edges(n.unionByName(s))


_EDGES = "e AS (SELECT lower(n_name) AS source, 'r' || n_regionkey AS target FROM nation UNION SELECT lower(s_name), 'nation_' || s_nationkey FROM supplier)"


@query("g1_entities", "SELECT lower(trim(p_name)) AS key, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1")
def g1(spark, sf_dir):
    return upsert_entities(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("pos")))


@query("g2_edges", f"WITH {_EDGES} SELECT source, target FROM e")
def g2(spark, sf_dir):
    return _edges(spark, sf_dir).select("source", "target")


@query("g3_ego_graph", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT lower(s_name) AS key, 0 AS distance FROM supplier WHERE s_suppkey < 10 UNION SELECT e.target, r.distance + 1 FROM r JOIN e ON e.source = r.key WHERE r.distance < 2),
n AS (SELECT DISTINCT key FROM r) SELECT DISTINCT source, target FROM e WHERE source IN (SELECT key FROM n) AND target IN (SELECT key FROM n)""")
def g3(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    start = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select(F.lower("s_name").alias("key"))
    return induced_edges(edges, ego_nodes(edges, start, 2)).select("source", "target").distinct()
