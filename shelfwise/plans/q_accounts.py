"""Account queries: PRJ-05..13, PRJ-15, PRJ-16, PRJ-18, AGG-06, WIN-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.timecols import cutoff, epoch_seconds, fmt_epoch, hours_ago, lock_active
from shelfwise.operators import accounts as A
from shelfwise.operators import rates as R
from shelfwise.plans.oracle_views import AS_OF, EPOCH, with_views
from shelfwise.plans.registry import register
from shelfwise.session import checkpoint_table, scratch_path
from shelfwise.sources.keyed_files import lookup_listed, write_for_lookup
from shelfwise.sources.tables import load, view

_STATUS_SQL = f"""CASE WHEN coalesce(u.disabled, false) OR coalesce(u.locked <> 0 AND u.locked > {{clock}} - 300, false)
                 THEN 'rejected' WHEN NOT coalesce(u.verified, false) THEN 'unverified' ELSE 'ok' END"""


@register("prj05_lookup", with_views("""
SELECT k.function_id, f.name, f.user_id, f.function_id IS NOT NULL AS found
FROM (SELECT DISTINCT function_id FROM rating_log) k LEFT JOIN functions f ON f.function_id = k.function_id""",
    "rating_log", "functions"))
def prj05_lookup(spark, d):
    keys = view(spark, d, "rating_log").select("function_id").distinct()
    f = view(spark, d, "functions").select("function_id", "name", "user_id")
    return A.lookup(f, keys, "function_id")


@register("prj05_lookup_files", with_views("""
SELECT k.user_id, u.username, u.admin, u.user_id IS NOT NULL AS found
FROM (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM auth_events WHERE user_id IS NOT NULL GROUP BY user_id)
      ORDER BY n DESC, user_id LIMIT 100) k LEFT JOIN users u ON u.user_id = k.user_id""", "auth_events", "users"))
def prj05_lookup_files(spark, d):
    # The hundred busiest accounts, looked up in files made for it.
    path = scratch_path(spark, "users")
    write_for_lookup(view(spark, d, "users").select("user_id", "username", "admin"), path, "user_id")
    busiest = view(spark, d, "auth_events").where("user_id IS NOT NULL").groupBy("user_id").count() \
        .orderBy(F.desc("count"), "user_id").limit(100).select("user_id")
    return lookup_listed(spark.read.parquet(path), checkpoint_table(busiest, "busiest"), "user_id")


@register("prj06_lock_active", with_views(f"""
SELECT user_id, locked, coalesce(locked <> 0 AND locked > {AS_OF - 300}, false) AS lock_active FROM users""",
    "users"))
def prj06_lock_active(spark, d):
    u = view(spark, d, "users")
    return u.select("user_id", "locked", lock_active("locked", AS_OF).alias("lock_active"))


@register("prj07_account_status", with_views(
    f"SELECT u.user_id, {_STATUS_SQL.format(clock=AS_OF)} AS status FROM users u", "users"))
def prj07_account_status(spark, d):
    return A.account_status(view(spark, d, "users"), AS_OF).select("user_id", "status")


@register("prj09_role", with_views(
    "SELECT user_id, CASE WHEN admin THEN 'admin' ELSE 'user' END AS role FROM users", "users"))
def prj09_role(spark, d):
    return view(spark, d, "users").select("user_id", A.role("admin").alias("role"))


_ATTEMPTS_SQL = "SELECT event_id AS attempt_id, CASE WHEN event_id % 10 = 3 THEN -1 - user_id ELSE user_id END AS user_id, event_time, success AS credentials_ok " \
                "FROM auth_events WHERE event_type = 'login'"


@register("prj08_login_outcome", with_views(f"""
WITH a AS ({_ATTEMPTS_SQL}),
j AS (SELECT a.*, u.user_id AS uid, {_STATUS_SQL.format(clock='a.event_time')} AS st
      FROM a LEFT JOIN users u ON u.user_id = a.user_id),
r AS (SELECT *, CASE WHEN uid IS NULL THEN 'invalid credentials' WHEN st = 'rejected' THEN 'rejected'
                     WHEN coalesce(credentials_ok, false) THEN 'ok' ELSE 'invalid credentials' END AS reason FROM j)
SELECT attempt_id, user_id, event_time, credentials_ok, reason, reason = 'ok' AS success,
       CASE WHEN uid IS NULL THEN 'Used does not exist' ELSE reason END AS log_reason,
       CASE WHEN uid IS NOT NULL THEN user_id END AS log_user_id
FROM r""", "auth_events", "users"))
def prj08_login_outcome(spark, d):
    # Attempts: login events, each naming the event's account (a tenth name one that does not exist);
    # the password check's outcome is an input (the event's success flag).
    ev = view(spark, d, "auth_events").filter(F.col("event_type") == "login")
    attempts = ev.select(F.col("event_id").alias("attempt_id"),
                         F.when(F.col("event_id") % 10 == 3, -1 - F.col("user_id")).otherwise(F.col("user_id")).alias("user_id"), "event_time",
                         F.col("success").alias("credentials_ok"))
    return A.login_outcome(attempts, view(spark, d, "users"), F.col("event_time"))


@register("prj10_access_decision", with_views(f"""
WITH q AS (SELECT event_id AS request_id, event_id - 1 AS session_id, {EPOCH} AS request_time FROM events),
j AS (SELECT q.*, s.session_id AS sid, s.user_id AS session_user_id, s.created, u.user_id AS uid,
             {_STATUS_SQL.format(clock='q.request_time')} AS st
      FROM q LEFT JOIN sessions s ON s.session_id = q.session_id LEFT JOIN users u ON u.user_id = s.user_id)
SELECT request_id, session_id, request_time, session_user_id,
       CASE WHEN sid IS NULL THEN 'invalid' WHEN created < request_time - 3600 THEN 'expired'
            WHEN uid IS NULL THEN 'invalid' WHEN st = 'ok' THEN 'allow' WHEN st = 'unverified' THEN 'verify'
            ELSE 'suspended' END AS decision
FROM j""", "sessions", "users"))
def prj10_access_decision(spark, d):
    # Requests: every event, presenting the id of the event before it as its
    # session id, judged at the request's own time.
    ev = load(spark, d, "events")
    req = ev.select(F.col("event_id").alias("request_id"), (F.col("event_id") - 1).alias("session_id"),
                    epoch_seconds("ts").alias("request_time"))
    return A.access_decision(req, view(spark, d, "sessions"), view(spark, d, "users"),
                             F.col("request_time"))


@register("prj11_fmt_epoch", with_views("""
SELECT session_id, created, strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS created_text
FROM sessions""", "sessions"))
def prj11_fmt_epoch(spark, d):
    s = view(spark, d, "sessions")
    return s.select("session_id", "created", fmt_epoch("created").alias("created_text"))


@register("prj12_trailing_counts", f"""
SELECT event_type, count(*) FILTER (WHERE {EPOCH} > {hours_ago(AS_OF, 1)}) AS last_hour,
       count(*) FILTER (WHERE {EPOCH} > {cutoff(AS_OF, 86400)}) AS last_day
FROM events GROUP BY event_type""")
def prj12_trailing_counts(spark, d):
    ev = load(spark, d, "events").select("event_type", epoch_seconds("ts").alias("t"))
    return ev.groupBy("event_type").agg(
        F.count_if(F.col("t") > F.lit(hours_ago(AS_OF, 1))).alias("last_hour"),
        F.count_if(F.col("t") > F.lit(cutoff(AS_OF, 86400))).alias("last_day"))


@register("prj13_client_ip", """
SELECT event_id, CASE event_type WHEN 'view' THEN concat('192.168.', cast(user_id % 256 AS varchar))
                                 WHEN 'click' THEN ''
                                 ELSE concat('10.0.0.', cast(user_id % 50 AS varchar)) END AS client_ip
FROM events""")
def prj13_client_ip(spark, d):
    # Header maps built from the events: views carry a forwarded-for address,
    # clicks an empty one (present, so it wins), the rest none.
    ev = load(spark, d, "events")
    et = F.col("event_type")
    headers = (F.when(et == "view", F.create_map(F.lit("X-Forwarded-For"),
                                                  F.concat(F.lit("192.168."), (F.col("user_id") % 256).cast("string"))))
               .when(et == "click", F.create_map(F.lit("X-Forwarded-For"), F.lit("")))
               .otherwise(F.create_map(F.lit("Accept"), F.lit("text/html"))))
    peer = F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string"))
    return ev.select("event_id", A.client_ip(headers, peer).alias("client_ip"))


_EMAIL = "CASE WHEN user_id % 5 = 4 THEN replace(username, '@', ' at ') WHEN user_id % 5 = 3 THEN upper(username) ELSE username END"


@register("prj15_email_domain", with_views(rf"""
WITH e AS (SELECT user_id, {_EMAIL} AS email FROM users),
v AS (SELECT *, regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s.]+$') AS email_valid FROM e),
n AS (SELECT *, CASE WHEN email_valid THEN lower(split_part(email, '@', -1)) END AS domain FROM v),
o AS (SELECT *, coalesce(domain IN ('automobile.example', 'machinery.example'), false) AS domain_ok FROM n)
SELECT user_id, email, email_valid, domain, domain_ok,
       CASE WHEN NOT email_valid THEN 'invalid address' WHEN NOT domain_ok THEN 'domain not allowed' ELSE '' END AS email_reason
FROM o""", "users"))
def prj15_email_domain(spark, d):
    # Addresses as typed: some in capitals, some without '@'.  The list's entry in capitals allows nothing.
    k, name = F.col("user_id") % 5, F.col("username")
    email = F.when(k == 4, F.replace(name, F.lit("@"), F.lit(" at "))).when(k == 3, F.upper(name)).otherwise(name)
    u = view(spark, d, "users").select("user_id", email.alias("email"))
    return A.email_domain_ok(u, "email", ["automobile.example", "machinery.example", "BUILDING.example"])


@register("prj16_verification_code", with_views("""
SELECT user_id, substr(md5(username), 1, 6) AS code,
       concat(substr(md5(username), 1, 3), ' - ', substr(md5(username), 4, 3)) AS shown
FROM users""", "users"))
def prj16_verification_code(spark, d):
    # Typed codes built from the username hash, with spaces and dashes as users type them.
    u = view(spark, d, "users")
    h = F.md5("username")
    typed = F.concat(F.substring(h, 1, 2), F.lit(" "), F.substring(h, 3, 2), F.lit("-"), F.substring(h, 5, 2))
    code = A.norm_code(typed)
    return u.select("user_id", code.alias("code"), A.fmt_code(code).alias("shown"))


@register("prj18_parse_rating", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 5
  WHEN 7 THEN CASE WHEN l_partkey % 10 BETWEEN 1 AND 5 THEN CAST(l_partkey % 10 AS INTEGER) END END AS rating
FROM lineitem""")
def prj18_parse_rating(spark, d):
    # Submitted texts by line number: ' 1 ', '+2', an Arabic or a mathematical three, '4.0', '0_5', '6', the part's last digit.
    li = load(spark, d, "lineitem")
    n = F.col("l_linenumber")
    text = (F.when(n == 1, " 1 ").when(n == 2, "+2").when(n == 3, F.when(F.col("l_partkey") % 2 == 0, "\u0663").otherwise("\U0001D7D1")).when(n == 4, "4.0")
            .when(n == 5, "0_5").when(n == 6, "6").otherwise((F.col("l_partkey") % 10).cast("string")))
    return li.select("l_orderkey", "l_linenumber", A.parse_rating(text).alias("rating"))


@register("agg06_recent_creates_total", with_views(f"""
SELECT count(*) AS creates FROM account_events WHERE event_type = 'create' AND event_time > {AS_OF - 86400}""",
    "account_events"))
def agg06_recent_creates_total(spark, d):
    return R.recent_creates_total(view(spark, d, "account_events"), AS_OF)


@register("agg06_recent_creates_by_ip", with_views(f"""
SELECT remote_ip, count(*) AS creates FROM account_events
WHERE event_type = 'create' AND event_time > {AS_OF - 86400} GROUP BY remote_ip""", "account_events"))
def agg06_recent_creates_by_ip(spark, d):
    return R.recent_creates_by_ip(view(spark, d, "account_events"), AS_OF)


@register("win02_rate_limit_audit", with_views("""
WITH c AS (SELECT event_id, event_time, remote_ip FROM account_events WHERE event_type = 'create'),
w AS (SELECT *, count(*) OVER (ORDER BY event_time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS total_24h,
             count(*) OVER (PARTITION BY remote_ip ORDER BY event_time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS ip_24h
      FROM c)
SELECT event_id, event_time, remote_ip, total_24h, ip_24h,
       CASE WHEN total_24h >= 5 THEN 'refused: total' WHEN ip_24h >= 2 THEN 'refused: address' ELSE 'allowed' END AS verdict
FROM w""", "account_events"))
def win02_rate_limit_audit(spark, d):
    return R.rate_limit_audit(view(spark, d, "account_events"))


@register("win02_rate_limit_audit_address", with_views("""
WITH c AS (SELECT event_id, event_time, remote_ip FROM account_events WHERE event_type = 'create'),
w AS (SELECT *, count(*) OVER (ORDER BY event_time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS total_24h,
             count(*) OVER (PARTITION BY remote_ip ORDER BY event_time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS ip_24h
      FROM c)
SELECT event_id, event_time, remote_ip, total_24h, ip_24h,
       CASE WHEN total_24h >= 1000000000 THEN 'refused: total' WHEN ip_24h >= 2 THEN 'refused: address' ELSE 'allowed' END AS verdict
FROM w""", "account_events"))
def win02_rate_limit_audit_address(spark, d):
    # A total limit that is out of reach, so that the address limit decides.
    return R.rate_limit_audit(view(spark, d, "account_events"), total_limit=10 ** 9)
