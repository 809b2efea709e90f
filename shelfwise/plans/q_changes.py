"""Constraint, change and source queries: VAL-01/02, JON-06, WIN-01, DML-01..05, SRC-01..03."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.timecols import epoch_seconds
from shelfwise.operators import changes as CH
from shelfwise.operators import constraints as V
from shelfwise.plans.oracle_views import AS_OF, with_views
from shelfwise.plans.registry import register
from shelfwise.session import scratch_path
from shelfwise.sources import writers as W
from shelfwise.sources.keyed_table import KeyedTable
from shelfwise.sources.tables import load, view

# ---------------------------------------------------------------- VAL / JON-06

# The lengths and ranges that the schema's rules state.
_FN_RULES = [
    V.Rule("functions.name not null", "not_null", "name"),
    V.Rule("functions.name length 3..50", "length", "name", 3, 50),
    V.Rule("functions.code length 10..1500", "length", "code", 10, 1500),
    V.Rule("functions.usecase length 10..500", "length", "usecase", 10, 500),
    V.Rule("functions.keywords length 3..200", "length", "keywords", 3, 200),
    V.Rule("functions.name unique", "unique", "name"),
]
_USER_RULES = [
    V.Rule("users.username length 14..100", "length", "username", 14, 100),
    V.Rule("users.username unique", "unique", "username"),
]
_RATING_RULES = [V.Rule("ratings.value between 1..5", "between", "value", 1, 5)]


def _rule_pred(rule: V.Rule) -> str:
    if rule.kind == "not_null":
        return f"{rule.column} IS NULL"
    if rule.kind == "length":
        return f"coalesce(NOT (length({rule.column}) BETWEEN {rule.lo} AND {rule.hi}), false)"
    return f"coalesce(NOT ({rule.column} BETWEEN {rule.lo} AND {rule.hi}), false)"


def _report_sql(table: str, rules: list[V.Rule]) -> list[str]:
    out = []
    for r in rules:
        if r.kind == "unique":
            out.append(f"SELECT '{r.name}' AS rule, CAST(coalesce(sum(k), 0) AS BIGINT) AS checked, "
                       f"CAST(coalesce(sum(CASE WHEN k > 1 THEN k END), 0) AS BIGINT) AS violations "
                       f"FROM (SELECT {r.column}, count(*) AS k FROM {table} WHERE {r.column} IS NOT NULL GROUP BY 1)")
        else:
            out.append(f"SELECT '{r.name}' AS rule, count(*) AS checked, count(*) FILTER (WHERE {_rule_pred(r)}) "
                       f"AS violations FROM {table}")
    return out


def _rows_sql(table: str, rules: list[V.Rule], key: str) -> list[str]:
    out = []
    for r in rules:
        if r.kind == "unique":
            out.append(f"SELECT '{r.name}' AS rule, {key} AS key FROM {table} WHERE {r.column} IN "
                       f"(SELECT {r.column} FROM {table} WHERE {r.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
        else:
            out.append(f"SELECT '{r.name}' AS rule, {key} AS key FROM {table} WHERE {_rule_pred(r)}")
    return out


# The tables with faults, so that every rule is broken somewhere: the remainder of the key says how.
_FAULTS_SQL = """bad_functions AS (SELECT function_id,
       CASE function_id % 40 WHEN 1 THEN NULL WHEN 2 THEN 'ab' WHEN 6 THEN 'taken' ELSE name END AS name,
       CASE function_id % 40 WHEN 3 THEN 'short' ELSE code END AS code,
       CASE function_id % 40 WHEN 4 THEN 'tiny' ELSE usecase END AS usecase,
       CASE function_id % 40 WHEN 5 THEN 'k' ELSE keywords END AS keywords FROM functions),
bad_users AS (SELECT user_id, CASE user_id % 40 WHEN 1 THEN 'a@b.c' WHEN 2 THEN 'taken@users.example' ELSE username END AS username FROM users)"""


def _bad_functions(spark, d):
    f, k = view(spark, d, "functions"), F.col("function_id") % 40
    return f.select(
        "function_id", F.when(k == 1, F.lit(None)).when(k == 2, "ab").when(k == 6, "taken").otherwise(F.col("name")).alias("name"),
        F.when(k == 3, "short").otherwise(F.col("code")).alias("code"), F.when(k == 4, "tiny").otherwise(F.col("usecase")).alias("usecase"),
        F.when(k == 5, "k").otherwise(F.col("keywords")).alias("keywords"))


def _bad_users(spark, d):
    u, k = view(spark, d, "users"), F.col("user_id") % 40
    return u.select("user_id", F.when(k == 1, "a@b.c").when(k == 2, "taken@users.example").otherwise(F.col("username")).alias("username"))


@register("val01_check_constraints", with_views(f"WITH {_FAULTS_SQL} " + "\nUNION ALL\n".join(
    _report_sql("bad_functions", _FN_RULES) + _report_sql("bad_users", _USER_RULES)
    + _report_sql("rating_log", _RATING_RULES)), "functions", "users", "rating_log"))
def val01_check_constraints(spark, d):
    return (V.check_constraints(_bad_functions(spark, d), _FN_RULES)
            .unionByName(V.check_constraints(_bad_users(spark, d), _USER_RULES))
            .unionByName(V.check_constraints(view(spark, d, "rating_log"), _RATING_RULES)))


@register("val01_violating_rows", with_views(f"WITH {_FAULTS_SQL} " + "\nUNION ALL\n".join(
    _rows_sql("bad_functions", _FN_RULES, "function_id") + _rows_sql("bad_users", _USER_RULES, "user_id")
    + _rows_sql("rating_log", _RATING_RULES, "seq")), "functions", "users", "rating_log"))
def val01_violating_rows(spark, d):
    return (V.violating_rows(_bad_functions(spark, d), _FN_RULES, "function_id")
            .unionByName(V.violating_rows(_bad_users(spark, d), _USER_RULES, "user_id"))
            .unionByName(V.violating_rows(view(spark, d, "rating_log"), _RATING_RULES, "seq")))


_VERDICT_SQL = """SELECT r.seq, r.user_id, r.function_id, r.value,
  CASE WHEN r.value IS NULL OR NOT (r.value BETWEEN 1 AND 5) THEN 'bad value'
       WHEN f.function_id IS NULL THEN 'unknown function'
       WHEN f.user_id = r.user_id THEN 'own function' ELSE 'accepted' END AS verdict
FROM rating_log r LEFT JOIN functions f ON f.function_id = r.function_id"""


@register("val02_rating_verdict", with_views(_VERDICT_SQL, "rating_log", "functions"))
def val02_rating_verdict(spark, d):
    return V.rating_verdict(view(spark, d, "rating_log"), view(spark, d, "functions"))


@register("val02_verdict_report", with_views(f"SELECT verdict, count(*) AS n FROM ({_VERDICT_SQL}) GROUP BY verdict",
                                             "rating_log", "functions"))
def val02_verdict_report(spark, d):
    return V.verdict_report(val02_rating_verdict(spark, d))


_FKS = [("ratings.function_id", "rating_log", "function_id", "functions", "function_id"),
        ("ratings.user_id", "rating_log", "user_id", "users", "user_id"),
        ("functions.user_id", "functions", "user_id", "users", "user_id"),
        ("sessions.user_id", "sessions", "user_id", "users", "user_id"),
        ("account_events.user_id", "account_events", "user_id", "users", "user_id"),
        ("auth_events.user_id", "auth_events", "user_id", "users", "user_id")]


@register("jon06_orphans", with_views("\nUNION ALL\n".join(
    f"SELECT '{n}' AS fk, count(*) AS orphans FROM {c} x WHERE x.{fk} IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM {p} y WHERE y.{pk} = x.{fk} AND y.{pk} % 11 <> 5)" for n, c, fk, p, pk in _FKS),
    "rating_log", "functions", "users", "sessions", "account_events", "auth_events"))
def jon06_orphans(spark, d):
    # Parents with gaps, so that every key has orphans.
    out = None
    for n, c, fk, p, pk in _FKS:
        o = V.orphans(view(spark, d, c), view(spark, d, p).filter(F.col(pk) % 11 != 5), fk, pk) \
            .agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("fk"), "orphans")
        out = o if out is None else out.unionByName(o)
    return out


@register("jon06_orphan_ratings", with_views("""
SELECT seq, user_id, function_id, value FROM rating_log r
WHERE NOT EXISTS (SELECT 1 FROM functions f WHERE f.function_id = r.function_id)""", "rating_log", "functions"))
def jon06_orphan_ratings(spark, d):
    return V.orphans(view(spark, d, "rating_log"), view(spark, d, "functions"), "function_id")


# ---------------------------------------------------------------- WIN-01 / DML

@register("win01_latest_per_key", with_views("""
SELECT seq, session_id, key, val FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY seq DESC) AS rn FROM kv_log) WHERE rn = 1""",
    "kv_log"))
def win01_latest_per_key(spark, d):
    return CH.latest_per_key(view(spark, d, "kv_log"), ["session_id", "key"], "seq")


_SPLIT = "1996-01-01"


def _validated_dated(spark, d):
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders")
    log = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("function_id"), F.col("l_linenumber").alias("value"),
        (F.col("o_orderdate") < F.lit(_SPLIT).cast("timestamp_ntz")).alias("early"))
    ok = V.exclude_self(log.filter(F.col("value").between(1, 5)), view(spark, d, "functions"))
    return ok


_DML01_SQL = with_views(f"""
WITH dl AS (SELECT l_orderkey*8 + l_linenumber AS seq, o_custkey AS user_id, l_partkey AS function_id,
                   l_linenumber AS value, o_orderdate < TIMESTAMP '{_SPLIT}' AS early
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ok AS (SELECT dl.* FROM dl JOIN functions f ON dl.function_id = f.function_id
       WHERE dl.value BETWEEN 1 AND 5 AND dl.user_id <> f.user_id),
cur AS (SELECT user_id, function_id, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, function_id ORDER BY seq DESC, value DESC) AS rn
          FROM ok WHERE early) WHERE rn = 1),
u AS (SELECT user_id, function_id, value, 0 AS src, CAST(NULL AS BIGINT) AS seq FROM cur
      UNION ALL SELECT user_id, function_id, value, 1, seq FROM ok WHERE NOT early)
SELECT user_id, function_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, function_id ORDER BY src DESC, seq DESC NULLS LAST, value DESC) AS rn
  FROM u) WHERE rn = 1""", "functions")


@register("dml01_upsert", _DML01_SQL)
def dml01_upsert(spark, d):
    # Current table: ratings from orders before 1996; changes: the submissions after it.
    ok = _validated_dated(spark, d)
    current = CH.latest_value(ok.filter("early"), ["user_id", "function_id"], "seq", ["value"], unique_order=True)
    changes = ok.filter(~F.col("early")).select("user_id", "function_id", "seq", "value")
    return CH.upsert(current, changes, ["user_id", "function_id"], "seq", ["value"], unique_order=True)


TABLE_BUCKETS = 16


@register("dml01_ratings_table", _DML01_SQL)
def dml01_ratings_table(spark, d):
    # The same, in a table on disk: only buckets that a submission hits are written again.
    ok = _validated_dated(spark, d)
    current = CH.latest_value(ok.filter("early"), ["user_id", "function_id"], "seq", ["value"], unique_order=True)
    ratings = KeyedTable.create(current, scratch_path(spark, "ratings"), ["user_id", "function_id"], TABLE_BUCKETS)
    ratings.upsert(ok.filter(~F.col("early")).select("user_id", "function_id", "seq", "value"), "seq", unique_order=True)
    return ratings.read()


_DML02_SQL = with_views("""
WITH a AS (SELECT seq, action_time, user_id, action,
                  CASE WHEN action IN ('promote', 'demote') THEN 'admin' WHEN action IN ('disable', 'enable') THEN 'disabled'
                       WHEN action = 'verify' THEN 'verified' WHEN action IN ('lock', 'unlock') THEN 'locked' END AS flag
           FROM actions),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, flag ORDER BY seq DESC) AS rn
                     FROM a WHERE flag IS NOT NULL) WHERE rn = 1)
SELECT u.user_id, u.username,
       CASE WHEN la.user_id IS NOT NULL THEN la.action = 'promote' ELSE u.admin END AS admin,
       CASE WHEN lv.user_id IS NOT NULL THEN true ELSE u.verified END AS verified,
       CASE WHEN ld.user_id IS NOT NULL THEN ld.action = 'disable' ELSE u.disabled END AS disabled,
       u.created,
       CASE WHEN ll.user_id IS NOT NULL THEN CASE WHEN ll.action = 'lock' THEN ll.action_time END ELSE u.locked END AS locked
FROM users u
LEFT JOIN l la ON la.user_id = u.user_id AND la.flag = 'admin'
LEFT JOIN l lv ON lv.user_id = u.user_id AND lv.flag = 'verified'
LEFT JOIN l ld ON ld.user_id = u.user_id AND ld.flag = 'disabled'
LEFT JOIN l ll ON ll.user_id = u.user_id AND ll.flag = 'locked'""", "users", "actions")


@register("dml02_apply_actions", _DML02_SQL)
def dml02_apply_actions(spark, d):
    return CH.apply_actions(view(spark, d, "users"), view(spark, d, "actions"))


@register("dml02_users_table", _DML02_SQL)
def dml02_users_table(spark, d):
    # The table on disk takes the log in two parts and is read back.
    users = KeyedTable.create(view(spark, d, "users"), scratch_path(spark, "users"), ["user_id"], TABLE_BUCKETS)
    log = view(spark, d, "actions")
    half = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    users.apply_actions(log.where(F.col("seq") <= half))
    users.apply_actions(log.where(F.col("seq") > half))
    return users.read()


def _cascade(spark, d):
    names = ["users", "functions", "sessions", "account_events", "auth_events", "ratings"]
    tables = {n: view(spark, d, n) for n in names}
    gone_users = tables["users"].filter("disabled").select("user_id")
    gone_fns = tables["functions"].filter(F.contains(F.lower("keywords"), F.lit("promo"))).select("function_id")
    return CH.cascade_delete(tables, gone_users, gone_fns)


_CASCADE_CTES = """gu AS (SELECT user_id FROM users WHERE disabled),
gf AS (SELECT function_id FROM functions WHERE user_id IN (SELECT user_id FROM gu)
       UNION SELECT function_id FROM functions WHERE contains(lower(keywords), 'promo')),
r2 AS (SELECT * FROM ratings WHERE user_id NOT IN (SELECT user_id FROM gu)
                              AND function_id NOT IN (SELECT function_id FROM gf))"""


@register("dml03_cascade_counts", with_views(f"""
WITH {_CASCADE_CTES}
SELECT 'users' AS table_name, count(*) AS n FROM users WHERE user_id NOT IN (SELECT user_id FROM gu)
UNION ALL SELECT 'functions', count(*) FROM functions WHERE function_id NOT IN (SELECT function_id FROM gf)
UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE user_id NOT IN (SELECT user_id FROM gu)
UNION ALL SELECT 'account_events', count(*) FROM account_events WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM gu)
UNION ALL SELECT 'auth_events', count(*) FROM auth_events WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM gu)
UNION ALL SELECT 'ratings', count(*) FROM r2""",
    "users", "functions", "sessions", "account_events", "auth_events", "ratings"))
def dml03_cascade_counts(spark, d):
    out = None
    for name, df in _cascade(spark, d).items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("dml03_ratings_after", with_views(f"WITH {_CASCADE_CTES} SELECT user_id, function_id, value FROM r2",
                                            "users", "functions", "ratings"))
def dml03_ratings_after(spark, d):
    return _cascade(spark, d)["ratings"]


@register("dml04_deleted_sessions", with_views(
    "SELECT session_id, user_id, created FROM sessions WHERE user_id IN (SELECT user_id FROM users WHERE disabled)",
    "sessions", "users"))
def dml04_deleted_sessions(spark, d):
    # Log out every disabled user: delete their sessions, returning the deleted rows.
    keys = view(spark, d, "users").filter("disabled").select("user_id")
    return CH.delete_returning(view(spark, d, "sessions"), keys, "user_id")[1]


@register("dml04_kept_sessions", with_views(
    "SELECT session_id, user_id, created FROM sessions WHERE user_id NOT IN (SELECT user_id FROM users WHERE disabled)",
    "sessions", "users"))
def dml04_kept_sessions(spark, d):
    keys = view(spark, d, "users").filter("disabled").select("user_id")
    return CH.delete_returning(view(spark, d, "sessions"), keys, "user_id")[0]


_FOLD_SQL = """SELECT session_id, key, val FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY seq DESC) AS rn FROM kv_log)
WHERE rn = 1 AND val IS NOT NULL"""


@register("dml05_fold_state", with_views(_FOLD_SQL, "kv_log"))
def dml05_fold_state(spark, d):
    return CH.fold_state(view(spark, d, "kv_log"))


@register("dml05_state_text", with_views(
    f"SELECT session_id, string_agg(concat(key, '=', val), ';' ORDER BY key) AS data FROM ({_FOLD_SQL}) GROUP BY session_id",
    "kv_log"))
def dml05_state_text(spark, d):
    m = CH.state_map(CH.fold_state(view(spark, d, "kv_log")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("data")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return m.select("session_id", text.alias("data"))


# ---------------------------------------------------------------- SRC

@register("src01_scan_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (epoch_us(o_orderdate) // 1000000) AS order_time,
       o_orderpriority FROM orders""")
def src01_scan_orders(spark, d):
    o = load(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                    epoch_seconds("o_orderdate").alias("order_time"), "o_orderpriority")


@register("src02_insert_users", with_views(f"""
WITH n AS (SELECT concat('supplier', lpad(cast(s_suppkey AS varchar), 9, '0'), '@supply.example') AS username
           FROM supplier)
SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY username) AS user_id, username,
       false AS admin, false AS verified, false AS disabled, CAST({AS_OF} AS BIGINT) AS created,
       CAST(NULL AS BIGINT) AS locked
FROM n""", "users"))
def src02_insert_users(spark, d):
    # Suppliers sign up as users: flags, created and ids come from the defaults.
    s = load(spark, d, "supplier")
    new = s.select(F.concat(F.lit("supplier"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"),
                            F.lit("@supply.example")).alias("username"))
    rows = W.insert_with_defaults(view(spark, d, "users"), new, "user_id", ["username"],
                                  {"admin": False, "verified": False, "disabled": False}, AS_OF)
    return rows.select("user_id", "username", "admin", "verified", "disabled", "created",
                       F.lit(None).cast("bigint").alias("locked"))


@register("src03_append_events", with_views("""
SELECT event_id, user_id, event_time, event_type, success, remote_ip,
       CASE WHEN event_type IN ('login', 'create') THEN '' END AS reason FROM auth_events
UNION ALL
SELECT event_id, user_id, event_time, event_type, success, remote_ip,
       CASE WHEN event_type IN ('login', 'create') THEN '' END AS reason FROM account_events""",
    "auth_events", "account_events"))
def src03_append_events(spark, d):
    # Append both logs (reason defaulted) to one type-partitioned table, then read it back.
    path = scratch_path(spark, "events-append")
    for name in ("auth_events", "account_events"):
        W.append_events(W.with_event_reason(view(spark, d, name)), path, name)
    back = spark.read.schema(
        "event_id bigint, user_id bigint, event_time bigint, success boolean, remote_ip string, "
        "reason string, event_type string, batch string").parquet(path)
    return back.select("event_id", "user_id", "event_time", "event_type", "success", "remote_ip", "reason")
