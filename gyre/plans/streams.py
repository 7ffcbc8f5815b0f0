"""Streams of events, compared with their batch twins, and joins on time."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyre.operators.temporal import asof_join, interval_join
from gyre.plans.reading import ST8
from gyre.plans.registry import oracle_sql, query
from gyre.session import fresh_path, table
from gyre.streaming.event_time import joined_within, sessions, windowed
from gyre.streaming.keyed import CircuitBreaker, Cooldown, TwoLimits, fold
from gyre.streaming.progress import PROGRESS, current, event_text, progress_of, upsert
from gyre.streaming.replay import replayed, replayed_into
from gyre.streaming.stateful import MachineProcessor, MicroBatchProcessor, SlidingLogProcessor, allowed_stream, batch_stream

DAY = 86400.0
_COLUMNS = {"key": "user_id", "order": "event_id", "seconds": "s", "value": "failed"}


def _arriving(spark, sf_dir, days=10, late=False):
    """Events with the slice that they arrive in: days days each; if late, every tenth event two slices after its own."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.floor(F.datediff("ts", F.lit("2024-01-01")) / days)
    if late:
        own = F.least(F.lit(4), own + F.when(F.col("event_id") % 10 == 3, 2).otherwise(0))
    return e.select("event_id", "user_id", "event_type", "value", "ts", (F.unix_micros("ts") / 1e6).alias("s"), (F.col("event_type") == "error").cast("double").alias("failed"), own.cast("int").alias("slice"))


def _with_end(events, slice_):
    """A last slice with one row far ahead, which lets the watermark pass all windows and timers; it belongs to no user and no type."""
    spark = events.sparkSession
    end = spark.range(1).select(F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(slice_).alias("slice"), F.lit(1893456000.0).alias("s"))
    return events.unionByName(end, allowMissingColumns=True)


_ARRIVED = "e AS (SELECT *, least(4, date_diff('day', DATE '2024-01-01', ts::DATE) // 6 + CASE WHEN event_id % 10 = 3 THEN 2 ELSE 0 END) AS slice FROM events)"


@query("st26_event_windows", f"""WITH {_ARRIVED}, m AS (SELECT s.slice, (SELECT date_trunc('millisecond', max(ts)) FROM e WHERE e.slice < s.slice) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT slice FROM e) s),
w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, mark FROM e JOIN m USING (slice)), j AS (SELECT user_id, start, coalesce(start + INTERVAL 6 HOUR <= mark, false) AS late FROM w)
SELECT user_id, start, count(*) AS n FROM j WHERE NOT late GROUP BY ALL UNION ALL SELECT user_id, NULL, count(*) FROM j WHERE late GROUP BY ALL""")
def st26_windows(spark, sf_dir):
    """Events of a user in windows of six hours, by a stream with a watermark of a day that reads five slices, every tenth event late; the late rows that were left out are in a row without a start."""
    e = _arriving(spark, sf_dir, 6, late=True)
    found = replayed(_with_end(e, 5), "slice", 6, lambda s: windowed(s, "user_id", "ts", "6 hours", "1 day")).where("user_id is not null")
    counted = found.groupBy("user_id").agg(F.sum("n").alias("counted"))
    missed = e.groupBy("user_id").count().join(counted, "user_id", "left").select("user_id", F.lit(None).cast("timestamp").alias("start"), (F.col("count") - F.coalesce("counted", F.lit(0))).alias("n")).where("n > 0")
    return found.unionByName(missed).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st26_session_windows", """WITH s AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def st26_sessions(spark, sf_dir):
    """Sessions of a user with less than six hours between events, by a stream that reads three slices in order."""
    found = replayed(_with_end(_arriving(spark, sf_dir), 3), "slice", 4, lambda s: sessions(s, "user_id", "ts", "6 hours", "1 day")).where("user_id is not null")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_WITHIN = """SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR"""


@query("st26_stream_join", _WITHIN)
def st26_join(spark, sf_dir):
    """Clicks with the purchases of the same user within twelve hours, by a join of two streams."""

    def joined(s):
        clicks = s.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
        purchases = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
        return joined_within(clicks, purchases, "user_id", "clicked", "bought", "12 HOURS", "1 day").select("user_id", "click_id", "purchase_id")

    return replayed(_arriving(spark, sf_dir), "slice", 3, joined)


@query("st6_sliding_log_stream", oracle_sql()["st6_sliding_log"])
def st6_stream(spark, sf_dir):
    return replayed(_arriving(spark, sf_dir), "slice", 3, lambda s: allowed_stream(s, SlidingLogProcessor(3, DAY, **_COLUMNS), "ts"))


@query("st7_circuit_breaker_stream", oracle_sql()["st7_circuit_breaker"])
def st7_stream(spark, sf_dir):
    return replayed(_arriving(spark, sf_dir), "slice", 3, lambda s: allowed_stream(s, MachineProcessor(lambda: CircuitBreaker(timeout=DAY), None, **_COLUMNS), "ts"))


@query("st21_alert_cooldown_stream", oracle_sql()["st21_alert_cooldown"])
def st21_stream(spark, sf_dir):
    """A day after its last event a key's cooldown is over, and its state ends."""
    return replayed(_arriving(spark, sf_dir).where("value > 40"), "slice", 3, lambda s: allowed_stream(s, MachineProcessor(lambda: Cooldown(DAY), DAY, **_COLUMNS), "ts"))


def _st8_rows() -> str:
    """The batch form's recursion, its rows as x."""
    parts, last = ST8.removeprefix("WITH RECURSIVE ").rsplit("\nSELECT ", 1)
    return f"{parts}, x AS (SELECT {last})"


# Requests a minute and an hour by role and by endpoint.
ROLE_LIMITS = {"admin": (1000, 10000), "teacher": (200, 2000), "student": (60, 600), "guest": (20, 100), "api": (500, 5000)}
ENDPOINT_LIMITS = {"/api/v2/auth/login": (10, 100), "/api/v2/auth/register": (5, 50), "/api/v2/content/upload": (5, 50), "/api/v2/content/process": (10, 100), "/api/v2/process": (30, 500), "/api/v2/embed": (100, 2000)}
#: The endpoint that a type of event stands for; others go by their user's role.
_ENDPOINTS = {"signup": "/api/v2/auth/register", "purchase": "/api/v2/content/process/run"}
_LIMITS = {i: x for i, x in enumerate([*ROLE_LIMITS.values(), *ENDPOINT_LIMITS.values()])}


def _kind(path: str) -> int:
    """The number of the first endpoint that begins a path."""
    return len(ROLE_LIMITS) + next(i for i, e in enumerate(ENDPOINT_LIMITS) if path.startswith(e))


def _limits_sql() -> str:
    """The two buckets from event to event; a day of events is taken as a second, so that limits are met."""
    case = lambda k: "CASE " + " ".join(f"WHEN event_type = '{t}' THEN {_LIMITS[_kind(p)][k]}" for t, p in _ENDPOINTS.items()) + " ELSE [" + ", ".join(str(x[k]) for x in ROLE_LIMITS.values()) + "][(user_id % 5 + 1)::INT] END"

    def before(at, tokens, last, limit, window):
        return f"CASE WHEN floor(e.s / {window}) <> {at} THEN floor({limit} * 1.5::DOUBLE) ELSE least(floor({limit} * 1.5::DOUBLE), {tokens} + (e.s - {last}) * {limit} / {window}.0::DOUBLE) END"

    m, h = before("r.m_at", "r.m_left", "r.m_last", "e.a_minute", 60), before("r.h_at", "r.h_left", "r.h_last", "e.an_hour", 3600)
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 8.64e10::DOUBLE AS s, {case(0)} AS a_minute, {case(1)} AS an_hour, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, floor(s / 60) AS m_at, floor(a_minute * 1.5::DOUBLE) - 1 AS m_left, s AS m_last, floor(s / 3600) AS h_at, floor(an_hour * 1.5::DOUBLE) - 1 AS h_left, s AS h_last, true AS allowed FROM e WHERE k = 1
UNION ALL SELECT user_id, event_id, k, floor(s / 60), m - (m >= 1)::INT, s, CASE WHEN m >= 1 THEN floor(s / 3600) ELSE h_at END, CASE WHEN m >= 1 THEN h - (h >= 1)::INT ELSE h_left END, CASE WHEN m >= 1 THEN s ELSE h_last END, m >= 1 AND h >= 1 FROM (SELECT e.user_id, e.event_id, e.k, e.s, r.h_at, r.h_left, r.h_last, {m} AS m, {h} AS h FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, event_id, allowed FROM r"""


@query("st5_role_and_endpoint", _limits_sql())
def st5_limits(spark, sf_dir):
    """The limits of a minute and of an hour by endpoint, or else by role, on a clock on which a day of events is a second."""
    e = _arriving(spark, sf_dir)
    kind = F.coalesce(*[F.when(F.col("event_type") == t, _kind(p)) for t, p in _ENDPOINTS.items()], F.pmod(F.col("user_id"), F.lit(5)))
    return fold(e.select("user_id", "event_id", (F.col("s") / DAY).alias("s"), kind.cast("double").alias("kind")), lambda: TwoLimits(_LIMITS), "user_id", "s", "event_id", "kind")


@query("st8_micro_batch_stream", f"""WITH RECURSIVE {_st8_rows()}, b AS (SELECT x.user_id, x.event_id, sum(x.allowed::INT) OVER o AS k, row_number() OVER o AS place FROM x JOIN events e USING (event_id) WINDOW o AS (PARTITION BY x.user_id ORDER BY e.ts, e.event_id))
SELECT user_id, arg_min(event_id, place) AS first, arg_max(event_id, place) AS last, count(*) AS n FROM b GROUP BY user_id, k""")
def st8_stream(spark, sf_dir):
    """Batches of four events of a user at most, released a day after their first by a timer if they don't fill."""
    e = _with_end(_arriving(spark, sf_dir), 3).na.fill({"user_id": -1, "event_id": -1})
    return replayed(e, "slice", 4, lambda s: batch_stream(s, MicroBatchProcessor(4, DAY, **_COLUMNS), "ts")).where("user_id >= 0")


@query("s21_progress_table", """SELECT user_id AS task, count(*) AS n, arg_max(event_type, (ts, event_id)) AS stage, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id""")
def s21_progress(spark, sf_dir):
    """Events as lines of an event stream that arrive in three slices; the table of each user's newest state that the stream keeps, and how many events the lines hold."""
    e = _arriving(spark, sf_dir)
    progress = e.select("slice", F.col("user_id").alias("task"), F.col("event_id").alias("id"), F.col("s").alias("at"), F.col("event_type").alias("stage"), F.col("value").alias("percent"))
    lines = progress.select("slice", F.explode(F.split(event_text(), "\n")).alias("value"))
    path = fresh_path(spark, "progress")
    replayed_into(lines, "slice", 3, progress_of, upsert(path))
    counted = progress_of(lines).groupBy("task").agg(F.count("*").alias("n"))
    return current(spark, path, PROGRESS).join(counted, "task").select("task", "n", "stage", "id")


@query("j18_asof", """SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) = 1""")
def j18_asof(spark, sf_dir):
    """Each purchase with the last view of its user before it, in buckets of a day."""
    e = _arriving(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", "s", F.col("event_id").alias("view_id"), "value")
    found = asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "s"), views, "user_id", "s", "view_id", DAY)
    return found.select("event_id", "user_id", "found.view_id", "found.value")


@query("j18_interval", _WITHIN)
def j18_interval(spark, sf_dir):
    """Clicks with the purchases of the same user within twelve hours, by an equi-join on buckets of six hours."""
    e = _arriving(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("s").alias("from"), (F.col("s") + 43200).alias("to"))
    purchases = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), "s")
    return interval_join(clicks, purchases, "user_id", "from", "to", "s", 21600.0).select("user_id", "click_id", "purchase_id")
