"""Streaming queries: STR-01..07, each run to completion with ``availableNow``
over the parquet file streams and read back from its sink (B: the result
equals the batch operator, so it shares that operator's SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import rates as R
from shelfwise.plans.oracle_views import EPOCH, with_views
from shelfwise.plans.registry import register
from shelfwise.sources.tables import kv_changes, load, view
from shelfwise.streaming import runner
from shelfwise.streaming import streams as ST

DELAY = "2 hours"
_DELAY = 2 * 3600
_WM_MS = f"(SELECT (max(epoch_us(ts)) // 1000) - {_DELAY * 1000} FROM events)"


def _watermark(types: str) -> str:
    """Seconds: the greatest event time of these types, less the delay."""
    return f"(SELECT max(epoch_us(ts) // 1000000) - {_DELAY} FROM events WHERE event_type IN ({types}))"


# STR-05's watermark is the lesser of its two inputs'.
_WM_EXPIRY = f"least({_watermark(repr('click'))}, {_watermark(repr('error') + ', ' + repr('view'))})"
_IP = "concat('10.0.0.', cast(user_id % 50 AS varchar))"

_INGEST_SQL = f"""SELECT event_id, user_id, event_type, value, {EPOCH} AS event_time FROM events
WHERE event_id IS NOT NULL AND user_id IS NOT NULL
  AND event_type IN ('signup', 'purchase', 'error', 'view', 'click')"""


def _with_repeats(ev):
    """Every seventh event comes twice, as a log that is sent again would bring it."""
    return ev.withColumn("_copy", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")


@register("str01_ingest_events", _INGEST_SQL)
def str01_ingest_events(spark, d):
    return runner.run_append(ST.ingest_events(_with_repeats(ST.event_stream(spark, d)), DELAY), "str01")


@register("str01_ingest_events_batch", _INGEST_SQL)
def str01_ingest_events_batch(spark, d):
    ev = load(spark, d, "events").withColumn("event_time", F.timestamp_diff(
        "SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")))
    return ST.ingest_events_batch(_with_repeats(ev))


@register("str02_create_rate_by_ip", f"""
WITH c AS (SELECT epoch_us(ts) AS us, {_IP} AS remote_ip FROM events WHERE event_type = 'signup'),
w AS (SELECT remote_ip, (us // 3600000000 - k) * 3600 AS window_start FROM c, range(24) r(k))
SELECT window_start, window_start + 86400 AS window_end, remote_ip, count(*) AS creates, count(*) >= 2 AS at_limit
FROM w GROUP BY ALL""")
def str02_create_rate_by_ip(spark, d):
    s = ST.create_rate_by_ip(ST.event_stream(spark, d), DELAY)
    return runner.run_update(s, "str02ip", ["window_start", "remote_ip"])


@register("str02_create_rate_daily", """
WITH c AS (SELECT (epoch_us(ts) // 86400000000) * 86400 AS window_start FROM events WHERE event_type = 'signup')
SELECT window_start, window_start + 86400 AS window_end, count(*) AS creates, count(*) >= 5 AS at_limit
FROM c GROUP BY ALL""")
def str02_create_rate_daily(spark, d):
    s = ST.create_rate_daily(ST.event_stream(spark, d), DELAY)
    return runner.run_update(s, "str02day", ["window_start"])


@register("str03_activity_sessions", f"""
WITH o AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS prev
           FROM events),
g AS (SELECT user_id, us, sum(CASE WHEN prev IS NULL OR us - prev >= 3600000000 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM o),
s AS (SELECT user_id, min(us) AS session_start_us, max(us) + 3600000000 AS session_end_us, count(*) AS events
      FROM g GROUP BY user_id, sid)
SELECT * FROM s WHERE session_end_us <= {_WM_MS} * 1000""")
def str03_activity_sessions(spark, d):
    return runner.run_append(ST.activity_sessions(ST.event_stream(spark, d), DELAY), "str03")


@register("str04_live_ratings", with_views("""
SELECT function_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total,
       CAST(((sum(value) * 20 + count(*)) // (2 * count(*))) AS DOUBLE) / 10 AS average
FROM ratings GROUP BY function_id""", "ratings"))
def str04_live_ratings(spark, d):
    live = ST.live_ratings(ST.rating_submissions(spark, d))
    return ST.live_averages(runner.run_update(live, "str04", ["function_id", "user_id"]))


@register("str05_expiry_events", f"""
WITH a AS (SELECT event_id, user_id, {EPOCH} AS t, event_type FROM events WHERE event_type IN ('error', 'view', 'click')),
lk AS (SELECT event_id, user_id, t, event_type, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next_t
       FROM a WHERE event_type IN ('error', 'view'))
SELECT user_id, 'unlocked' AS kind, event_id AS ref_id, t + 300 AS due FROM lk
WHERE event_type = 'error' AND (t + 300 <= next_t OR next_t IS NULL) AND t + 300 <= {_WM_EXPIRY}
UNION ALL
SELECT user_id, 'expired', event_id, t + 3600 FROM a WHERE event_type = 'click' AND t + 3600 <= {_WM_EXPIRY}""")
def str05_expiry_events(spark, d):
    return runner.run_append(ST.expiry_events(ST.event_stream(spark, d), DELAY), "str05")


_ADMIT_SQL = f"""
WITH RECURSIVE c AS (
  SELECT event_id, {_IP} AS remote_ip, {EPOCH} AS event_time,
         row_number() OVER (PARTITION BY {_IP} ORDER BY {EPOCH}, event_id) AS rn
  FROM events WHERE event_type = 'signup'),
r AS (
  SELECT remote_ip, rn, event_id, event_time, true AS admitted, event_time AS a1, CAST(NULL AS BIGINT) AS a2
  FROM c WHERE rn = 1
  UNION ALL
  SELECT remote_ip, rn, event_id, event_time, adm, CASE WHEN adm THEN event_time ELSE a1 END,
         CASE WHEN adm THEN a1 ELSE a2 END
  FROM (SELECT c.remote_ip, c.rn, c.event_id, c.event_time, r.a1, r.a2,
               (CASE WHEN r.a1 > c.event_time - 86400 THEN 1 ELSE 0 END
                + CASE WHEN r.a2 > c.event_time - 86400 THEN 1 ELSE 0 END) < 2 AS adm
        FROM r JOIN c ON c.remote_ip = r.remote_ip AND c.rn = r.rn + 1))
SELECT event_id, remote_ip, event_time, admitted FROM r"""


@register("str06_admit", _ADMIT_SQL + f" WHERE event_time + 1 <= {_watermark(repr('signup'))}")
def str06_admit(spark, d):
    # Decided as far as the watermark has come.
    return runner.run_append(ST.admit(ST.event_stream(spark, d), DELAY), "str06")


@register("str06_admit_batch", _ADMIT_SQL)
def str06_admit_batch(spark, d):
    return R.admit_batch(view(spark, d, "account_events"))


@register("str07_live_state", with_views("""
SELECT session_id, key, val FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY seq DESC) AS rn FROM kv_log)
WHERE rn = 1 AND val IS NOT NULL""", "kv_log"))
def str07_live_state(spark, d):
    changes = kv_changes(ST.event_stream(spark, d), "event_ts")
    live = ST.latest_contents(runner.run_update(ST.live_state(changes, DELAY), "str07", ["period", "session_id", "key"]))
    return live.filter(F.col("val").isNotNull()).select("session_id", "key", "val")


# A session ends 3600 s after its last change (whole seconds); what it then holds, as "key=value" in key order.
@register("str07_expired_contents", f"""
WITH c AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) // 1000000 AS t, concat('k', cast(event_id % 5 AS varchar)) AS key,
                  CASE WHEN event_type = 'error' THEN NULL ELSE cast(event_id AS varchar) END AS val FROM events),
o AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY t, seq) AS prev FROM c),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR t - prev >= 3600 THEN 1 ELSE 0 END)
                OVER (PARTITION BY session_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS sid FROM o),
e AS (SELECT session_id, sid, max(t) + 3600 AS expired FROM g GROUP BY session_id, sid),
l AS (SELECT session_id, sid, key, arg_max(coalesce(val, ''), seq) AS val FROM g GROUP BY session_id, sid, key)
SELECT e.session_id, CAST(expired AS BIGINT) AS expired, coalesce(string_agg(key || '=' || val, ',' ORDER BY key) FILTER (val <> ''), '') AS contents
FROM e JOIN l ON l.session_id = e.session_id AND l.sid = e.sid
WHERE expired * 1000 + 1000 <= {_WM_MS} GROUP BY ALL""")
def str07_expired_contents(spark, d):
    out = runner.run_append(ST.expired_contents(kv_changes(ST.event_stream(spark, d), "event_ts"), DELAY), "str07end")
    entries = F.transform(F.array_sort(F.map_entries("data")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return out.select("session_id", "expired", F.array_join(entries, ",").alias("contents"))
