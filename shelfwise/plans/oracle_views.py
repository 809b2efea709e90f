"""The stand-in views as DuckDB SQL, for the independent oracle queries.

Each oracle query is ``WITH <views it needs> <body>``; the views are the
FIXTURES.md section 3 definitions with DuckDB's epoch expression.  The oracle
is written separately from the Spark code and, where it can, takes another
route (integer arithmetic for rounding, ``row_number`` for last-write-wins).
"""

from __future__ import annotations

AS_OF = 1706659199
EPOCH = "(epoch_us(ts) // 1000000)"

VIEW_SQL: dict[str, str] = {
    "users": """SELECT c_custkey AS user_id,
       concat('customer', lpad(cast(c_custkey AS varchar), 9, '0'), '@', lower(c_mktsegment), '.example') AS username,
       c_nationkey = 0 AS admin, c_acctbal >= 0 AS verified, c_custkey % 17 = 0 AS disabled,
       1704067200 + c_custkey*60 AS created,
       CASE WHEN c_custkey % 5 = 0 THEN 1706659199 - c_custkey % 600 END AS locked
FROM customer""",
    "functions": """SELECT doc_id AS function_id, doc_id % 97 AS user_id,
       concat(replace(p_name,' ','_'),'_',cast(doc_id AS varchar)) AS name, text AS code,
       concat('Use ',p_name,' at ',cast(p_size AS varchar),
              CASE WHEN p_size % 2 = 0 THEN '% load' ELSE ' pct_load' END) AS usecase,
       concat(replace(p_name,' ',' , '),', ',lower(p_type),', ',lang,' ,',lang) AS keywords
FROM documents JOIN part ON doc_id = p_partkey""",
    "rating_log": """SELECT l_orderkey*8 + l_linenumber AS seq, o_custkey AS user_id,
       l_partkey AS function_id, l_linenumber AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """SELECT user_id, function_id, value FROM (
  SELECT r.user_id, r.function_id, r.value,
         row_number() OVER (PARTITION BY r.user_id, r.function_id ORDER BY r.seq DESC, r.value DESC) AS rn
  FROM rating_log r JOIN functions f ON r.function_id = f.function_id
  WHERE r.value BETWEEN 1 AND 5 AND r.user_id <> f.user_id) WHERE rn = 1""",
    "sessions": f"""SELECT event_id AS session_id, user_id, {EPOCH} AS created
FROM events WHERE event_type = 'click'""",
    "account_events": f"""SELECT event_id, user_id, {EPOCH} AS event_time,
       CASE event_type WHEN 'signup' THEN 'create' ELSE 'other' END AS event_type,
       value >= 20 AS success, concat('10.0.0.', cast(user_id % 50 AS varchar)) AS remote_ip
FROM events WHERE event_type IN ('signup','purchase')""",
    "auth_events": f"""SELECT event_id, user_id, {EPOCH} AS event_time,
       CASE event_type WHEN 'click' THEN 'login' ELSE 'verification' END AS event_type,
       value >= 20 AS success, concat('10.0.0.', cast(user_id % 50 AS varchar)) AS remote_ip
FROM events WHERE event_type IN ('click','view')""",
    "kv_log": """SELECT event_id AS seq, user_id AS session_id, concat('k', cast(event_id % 5 AS varchar)) AS key,
       CASE WHEN event_type = 'error' THEN NULL ELSE cast(event_id AS varchar) END AS val FROM events""",
    "actions": f"""SELECT event_id AS seq, {EPOCH} AS action_time, user_id,
       CASE event_type WHEN 'signup' THEN 'promote' WHEN 'purchase' THEN 'disable' WHEN 'error' THEN 'lock'
                       WHEN 'view' THEN 'unlock' ELSE 'enable' END AS action FROM events""",
}

DEPENDS = {"ratings": ["rating_log", "functions"]}
ORDER = ["users", "functions", "rating_log", "ratings", "sessions", "account_events",
         "auth_events", "kv_log", "actions"]


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and their dependencies)."""
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        for dep in DEPENDS.get(n, []):
            add(dep)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in ORDER if n in need]
    if not ctes:
        return body
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
