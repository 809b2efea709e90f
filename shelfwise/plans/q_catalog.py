"""Catalog queries: JON-01..05, AGG-01..05, AGG-07, SRT-01/02, PRJ-17."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import catalog as C
from shelfwise.plans.oracle_views import AS_OF, with_views
from shelfwise.plans.registry import register
from shelfwise.session import scratch_path
from shelfwise.sources.listing import Listing
from shelfwise.sources.tables import view

# Exact half-up rounding of sum/n to d digits with integer arithmetic (oracle side).
def _round_sql(s: str, n: str, d: int) -> str:
    p = 10 ** d
    return f"(CAST(((({s}) * {2 * p} + ({n})) // (2 * ({n}))) AS DOUBLE) / {p})"


_AVG_CTE = "ra AS (SELECT function_id, sum(value) AS s, count(*) AS n FROM ratings GROUP BY function_id)"


@register("jon02_list_functions", with_views(f"""
WITH {_AVG_CTE}
SELECT f.function_id, f.name, f.usecase, f.keywords, u.username,
       {_round_sql('ra.s', 'ra.n', 1)} AS average
FROM functions f JOIN users u ON f.user_id = u.user_id
LEFT JOIN ra ON ra.function_id = f.function_id""", "functions", "users", "ratings"))
def jon02_list_functions(spark, d):
    return C.list_functions(view(spark, d, "functions"), view(spark, d, "users"),
                            view(spark, d, "ratings"))


@register("srt01_top_rated", with_views(f"""
WITH {_AVG_CTE},
cat AS (SELECT f.function_id, f.name, f.usecase, f.keywords, u.username,
               {_round_sql('ra.s', 'ra.n', 1)} AS average
        FROM functions f JOIN users u ON f.user_id = u.user_id
        LEFT JOIN ra ON ra.function_id = f.function_id)
SELECT * FROM cat ORDER BY average DESC NULLS LAST, function_id LIMIT 20""",
    "functions", "users", "ratings"))
def srt01_top_rated(spark, d):
    return C.top_rated(jon02_list_functions(spark, d), 20)


@register("jon01_function_details", with_views("""
SELECT f.function_id, f.user_id, f.name, f.code, f.usecase, f.keywords, u.username
FROM functions f JOIN users u ON f.user_id = u.user_id""", "functions", "users"))
def jon01_function_details(spark, d):
    return C.function_details(view(spark, d, "functions"), view(spark, d, "users")) \
        .select("function_id", "user_id", "name", "code", "usecase", "keywords", "username")


@register("jon03_functions_by_user", with_views(f"""
WITH {_AVG_CTE}
SELECT f.function_id, f.user_id, f.name, f.usecase, f.keywords,
       {_round_sql('ra.s', 'ra.n', 2)} AS average
FROM functions f LEFT JOIN ra ON ra.function_id = f.function_id
WHERE f.user_id IN (SELECT user_id FROM users WHERE locked IS NOT NULL)""", "functions", "users", "ratings"))
def jon03_functions_by_user(spark, d):
    # The authors an administrator reviews: those with a lock on record.
    locked = view(spark, d, "users").filter("locked IS NOT NULL").select("user_id")
    return C.functions_by_user(view(spark, d, "functions"), view(spark, d, "ratings"), locked)


def _list_users_sql(lifetime: int) -> str:
    # Mean of per-function means: sum of exact means kept as DECIMAL(38,18) like the
    # Spark side; the round is done with integer arithmetic on the 10^-18 units.
    return with_views(f"""
WITH ra AS (SELECT function_id, sum(value) AS s, count(*) AS n FROM ratings GROUP BY function_id),
pf AS (SELECT f.user_id, f.function_id,
              CASE WHEN ra.n > 0 THEN (CAST(ra.s AS HUGEINT) * 1000000000000000000 * 2 + ra.n) // (2 * ra.n) END AS m18
       FROM functions f LEFT JOIN ra ON ra.function_id = f.function_id),
fa AS (SELECT user_id, count(*) AS functions, sum(m18) AS sm, count(m18) AS nm FROM pf GROUP BY user_id),
sa AS (SELECT user_id, count(*) AS sessions FROM sessions WHERE created > {AS_OF - lifetime} GROUP BY user_id)
SELECT u.user_id, u.username, u.admin, u.verified, u.disabled,
       strftime(make_timestamp(u.created * 1000000), '%Y-%m-%d %H:%M:%S') AS created,
       coalesce(u.locked <> 0 AND u.locked > {AS_OF - 300}, false) AS locked,
       sa.sessions, fa.functions,
       CASE WHEN fa.nm > 0 THEN CAST(((((fa.sm * 2 + fa.nm) // (2 * fa.nm)) * 2 + 10000000000000000)
                                     // 20000000000000000) AS DOUBLE) / 100 END AS average
FROM users u LEFT JOIN sa ON sa.user_id = u.user_id LEFT JOIN fa ON fa.user_id = u.user_id""",
        "users", "sessions", "functions", "ratings")


@register("jon04_list_users", _list_users_sql(3600))
def jon04_list_users(spark, d):
    return C.list_users(view(spark, d, "users"), view(spark, d, "sessions"),
                        view(spark, d, "functions"), view(spark, d, "ratings"), AS_OF, 3600)


@register("jon04_list_users_24h", _list_users_sql(86400))
def jon04_list_users_24h(spark, d):
    return C.list_users(view(spark, d, "users"), view(spark, d, "sessions"),
                        view(spark, d, "functions"), view(spark, d, "ratings"), AS_OF, 86400)


@register("agg01_avg_rating", with_views(f"""
SELECT function_id, {_round_sql('sum(value)', 'count(*)', 0)} AS average_0,
       {_round_sql('sum(value)', 'count(*)', 1)} AS average_1,
       {_round_sql('sum(value)', 'count(*)', 2)} AS average_2
FROM ratings GROUP BY function_id""", "ratings"))
def agg01_avg_rating(spark, d):
    return C.avg_rating(view(spark, d, "ratings"), [0, 1, 2])


@register("agg02_avg_rating_or_zero", with_views(f"""
WITH {_AVG_CTE}
SELECT f.function_id, coalesce({_round_sql('ra.s', 'ra.n', 0)}, 0.0) AS average
FROM functions f LEFT JOIN ra ON ra.function_id = f.function_id""", "functions", "ratings"))
def agg02_avg_rating_or_zero(spark, d):
    ids = view(spark, d, "functions").select("function_id")
    return C.avg_rating_or_zero(ids, view(spark, d, "ratings"))


@register("agg03_own_rating", with_views("""
SELECT p.seq, p.function_id, p.user_id, CAST(coalesce(r.value, 0) AS BIGINT) AS own_rating
FROM rating_log p LEFT JOIN ratings r ON r.function_id = p.function_id AND r.user_id = p.user_id""",
    "rating_log", "ratings"))
def agg03_own_rating(spark, d):
    pairs = view(spark, d, "rating_log").select("seq", "function_id", "user_id")
    return C.own_rating(pairs, view(spark, d, "ratings"))


def _active_sql(lifetime: int) -> str:
    return with_views(f"""
SELECT u.user_id, coalesce(s.n, 0) AS active_sessions FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n FROM sessions WHERE created > {AS_OF - lifetime} GROUP BY user_id) s
ON s.user_id = u.user_id""", "users", "sessions")


@register("agg04_active_sessions", _active_sql(3600))
def agg04_active_sessions(spark, d):
    return C.active_sessions(view(spark, d, "users"), view(spark, d, "sessions"), AS_OF, 3600)


@register("agg04_active_sessions_24h", _active_sql(86400))
def agg04_active_sessions_24h(spark, d):
    return C.active_sessions(view(spark, d, "users"), view(spark, d, "sessions"), AS_OF, 86400)


@register("agg05_author_summary", with_views("""
WITH ra AS (SELECT function_id, sum(value) AS s, count(*) AS n FROM ratings GROUP BY function_id),
pf AS (SELECT f.user_id, CASE WHEN ra.n > 0 THEN (CAST(ra.s AS HUGEINT) * 1000000000000000000 * 2 + ra.n) // (2 * ra.n) END AS m18
       FROM functions f LEFT JOIN ra ON ra.function_id = f.function_id),
fa AS (SELECT user_id, count(*) AS functions, sum(m18) AS sm, count(m18) AS nm FROM pf GROUP BY user_id)
SELECT user_id, functions,
       CASE WHEN nm > 0 THEN CAST(((((sm * 2 + nm) // (2 * nm)) * 2 + 10000000000000000)
                                  // 20000000000000000) AS DOUBLE) / 100 END AS average
FROM fa""", "functions", "ratings"))
def agg05_author_summary(spark, d):
    return C.author_summary(view(spark, d, "functions"), view(spark, d, "ratings"))


@register("jon05_exclude_self", with_views("""
SELECT r.seq, r.user_id, r.function_id, r.value FROM rating_log r
JOIN functions f ON r.function_id = f.function_id
WHERE r.user_id <> f.user_id""", "rating_log", "functions"))
def jon05_exclude_self(spark, d):
    from shelfwise.operators.constraints import exclude_self
    return exclude_self(view(spark, d, "rating_log"), view(spark, d, "functions"))


@register("prj17_permissions", with_views("""
SELECT p.seq, p.function_id, p.user_id, f.user_id AS author_id,
       (f.user_id = p.user_id OR coalesce(u.admin, false)) AS may_delete,
       f.user_id <> p.user_id AS may_rate
FROM rating_log p JOIN functions f ON f.function_id = p.function_id
LEFT JOIN users u ON u.user_id = p.user_id""", "rating_log", "functions", "users"))
def prj17_permissions(spark, d):
    pairs = view(spark, d, "rating_log").select("seq", "function_id", "user_id")
    return C.permissions(pairs, view(spark, d, "functions"), view(spark, d, "users"))


@register("agg07_function_view", with_views(f"""
WITH {_AVG_CTE},
p AS (SELECT DISTINCT function_id, user_id FROM rating_log)
SELECT p.function_id, p.user_id, f.user_id AS author_id,
       (f.user_id = p.user_id OR coalesce(v.admin, false)) AS may_delete,
       f.user_id <> p.user_id AS may_rate,
       f.name, f.usecase, a.username,
       array_to_string(list_transform(string_split(f.keywords, ','), lambda x: trim(x)), '|') AS keyword_list,
       coalesce({_round_sql('ra.s', 'ra.n', 0)}, 0.0) AS average,
       CAST(coalesce(r.value, 0) AS BIGINT) AS own_rating
FROM p JOIN functions f ON f.function_id = p.function_id
JOIN users a ON a.user_id = f.user_id
LEFT JOIN users v ON v.user_id = p.user_id
LEFT JOIN ra ON ra.function_id = p.function_id
LEFT JOIN ratings r ON r.function_id = p.function_id AND r.user_id = p.user_id""",
    "rating_log", "functions", "users", "ratings"))
def agg07_function_view(spark, d):
    pairs = view(spark, d, "rating_log").select("function_id", "user_id").distinct()
    out = C.function_view(pairs, view(spark, d, "functions"), view(spark, d, "users"),
                          view(spark, d, "ratings"))
    return out.withColumn("keyword_list", F.array_join("keyword_list", "|"))


_RANKED = """
WITH c AS (SELECT f.function_id, f.name, CAST((sum(r.value) * 20 + count(*)) // (2 * count(*)) AS DOUBLE) / 10 AS average
           FROM functions f LEFT JOIN ratings r ON r.function_id = f.function_id AND f.function_id % 3 <> 0
           GROUP BY f.function_id, f.name),"""


def _rated(spark, d):
    """Functions with their average; every third one is unrated."""
    f, r = view(spark, d, "functions"), view(spark, d, "ratings").filter("function_id % 3 <> 0")
    return f.select("function_id", "name").join(C.avg_rating(r, 1), "function_id", "left").select("function_id", "name", "average")


def _walk(df, sort, descending, after):
    """The 50 rows after a page's last row, with the number of the page."""
    parts = [C.page(df, sort, "function_id", 50, a, descending).withColumn("page", F.lit(i)) for i, a in enumerate(after)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("srt02_page", with_views("""
SELECT function_id, name, user_id FROM functions
WHERE name > 'lavender' OR (name = 'lavender' AND function_id > 0)
ORDER BY name, function_id LIMIT 50""", "functions"))
def srt02_page(spark, d):
    f = view(spark, d, "functions").select("function_id", "name", "user_id")
    return C.page(f, "name", "function_id", 50, after=("lavender", 0))


def _page_sql(order: str, wheres: list[str]) -> str:
    parts = [f"p{i} AS (SELECT *, {i} AS page FROM c WHERE {w} ORDER BY {order}, function_id LIMIT 50)" for i, w in enumerate(wheres)]
    return with_views(_RANKED + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(wheres))),
                      "functions", "ratings")


@register("srt02_page_average", _page_sql("average NULLS LAST", [
    "true", "average > 3.0 OR (average = 3.0 AND function_id > 20) OR average IS NULL",
    "average > 4.9 OR (average = 4.9 AND function_id > 0) OR average IS NULL", "average IS NULL AND function_id > 30"]))
def srt02_page_average(spark, d):
    # Pages by average, upwards: the first, one inside, one that runs into the unrated, one among them.
    return _walk(_rated(spark, d), "average", False, [None, (3.0, 20), (4.9, 0), (None, 30)])


@register("srt02_page_average_desc", _page_sql("average DESC NULLS LAST", [
    "true", "average < 3.0 OR (average = 3.0 AND function_id > 20) OR average IS NULL",
    "average < 1.1 OR (average = 1.1 AND function_id > 0) OR average IS NULL", "average IS NULL AND function_id > 30"]))
def srt02_page_average_desc(spark, d):
    # The same, downwards.
    return _walk(_rated(spark, d), "average", True, [None, (3.0, 20), (1.1, 0), (None, 30)])


def _listing_sql(order: str) -> str:
    return with_views(_RANKED + f"""
n AS (SELECT *, row_number() OVER (ORDER BY {order}, function_id) - 1 AS place FROM c)
SELECT function_id, name, average, CAST(place // 50 AS INTEGER) AS page FROM n WHERE place < 200""", "functions", "ratings")


def _listing_pages(spark, d, descending):
    """The first four pages of a listing, each after the last row of the one before."""
    listing = Listing.build(_rated(spark, d), scratch_path(spark, "listing"), "average", "function_id", descending)
    out, after = None, None
    for i in range(4):
        p = listing.page(50, after).withColumn("page", F.lit(i))
        out = p if out is None else out.unionByName(p)
        last = p.select("average", "function_id").tail(1)
        if not last:
            break
        after = tuple(last[0])
    return out


@register("srt02_listing", _listing_sql("average NULLS LAST"))
def srt02_listing(spark, d):
    # The catalog by average, written once; a page opens the ranges that hold it.
    return _listing_pages(spark, d, False)


@register("srt02_listing_desc", _listing_sql("average DESC NULLS LAST"))
def srt02_listing_desc(spark, d):
    return _listing_pages(spark, d, True)
