"""Catalog queries: joins, rating aggregates and listings (JON-01..05, AGG-01..05,
AGG-07, SRT-01/02, PRJ-17).

Ratings are always aggregated *before* they are joined (one row per function
leaves the aggregate), so the join never multiplies rating rows.  Every join is
an equi-join; Spark/AQE choose broadcast or sort-merge from measured sizes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numeric import exact_mean, round_half_up
from shelfwise.functions.text import split_keywords
from shelfwise.functions.timecols import cutoff, fmt_epoch, lock_active


def rating_sums(r: DataFrame) -> DataFrame:
    """(function_id, n, total): the partial-aggregatable core of every mean."""
    return r.groupBy("function_id").agg(F.count("value").alias("n"),
                                        F.sum("value").alias("total"))


def avg_rating(r: DataFrame, digits: int | Sequence[int] = 1) -> DataFrame:
    """AGG-01: exact mean rating per function, rounded half away from zero.

    With a list of digits one column ``average_<d>`` per entry is returned.
    """
    s = rating_sums(r)
    m = exact_mean(F.col("total"), F.col("n"))
    if isinstance(digits, int):
        return s.select("function_id", round_half_up(m, digits).alias("average"))
    return s.select("function_id", *[round_half_up(m, d).alias(f"average_{d}") for d in digits])


def avg_rating_or_zero(ids: DataFrame, r: DataFrame, digits: int = 0) -> DataFrame:
    """AGG-02: mean rating (0 digits) for each function id in ``ids``; unrated -> 0."""
    return ids.join(avg_rating(r, digits), "function_id", "left") \
        .withColumn("average", F.coalesce(F.col("average"), F.lit(0.0)))


def own_rating(pairs: DataFrame, r: DataFrame) -> DataFrame:
    """AGG-03: each (function_id, user_id) pair's own rating; none -> 0."""
    s = r.groupBy("function_id", "user_id").agg(F.sum("value").alias("_own"))
    return pairs.join(s, ["function_id", "user_id"], "left") \
        .withColumn("own_rating", F.coalesce(F.col("_own"), F.lit(0)).cast("bigint")).drop("_own")


def function_details(f: DataFrame, u: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """JON-01: functions with their author's username (inner join)."""
    if ids is not None:
        f = f.join(ids.select("function_id").distinct(), "function_id", "left_semi")
    return f.join(u.select("user_id", "username"), "user_id", "inner")


def list_functions(f: DataFrame, u: DataFrame, r: DataFrame, digits: int = 1) -> DataFrame:
    """JON-02: catalog = functions inner users left (mean rating rounded to 1)."""
    return (f.select("function_id", "user_id", "name", "usecase", "keywords")
            .join(u.select("user_id", "username"), "user_id", "inner")
            .join(avg_rating(r, digits), "function_id", "left")
            .select("function_id", "name", "usecase", "keywords", "username", "average"))


def functions_by_user(f: DataFrame, r: DataFrame, user_ids: DataFrame, digits: int = 2) -> DataFrame:
    """JON-03: the functions of the given authors with mean rating rounded to 2.

    Ratings are summed before the join: a row per function and task is shuffled, and the functions
    are derived once.
    """
    fs = f.join(user_ids.select("user_id").distinct(), "user_id", "left_semi") \
        .select("function_id", "user_id", "name", "usecase", "keywords")
    return fs.join(avg_rating(r, digits), "function_id", "left")


def author_summary(f: DataFrame, r: DataFrame, digits: int = 2) -> DataFrame:
    """AGG-05: per author, function count and mean of per-function means.

    Unrated functions count as functions but do not enter the mean.
    """
    per_fn = rating_sums(r).select("function_id", exact_mean(F.col("total"), F.col("n")).alias("m"))
    j = f.select("function_id", "user_id").join(per_fn, "function_id", "left")
    agg = j.groupBy("user_id").agg(F.count(F.lit(1)).alias("functions"),
                                   F.sum("m").alias("_sm"), F.count("m").alias("_nm"))
    mean = F.when(F.col("_nm") > 0, F.col("_sm") / F.col("_nm").cast("decimal(20,0)"))
    return agg.select("user_id", "functions", round_half_up(mean, digits).alias("average"))


def active_session_counts(s: DataFrame, as_of: int, lifetime: int = 3600) -> DataFrame:
    """Sessions per user with ``created > as_of - lifetime`` (strict)."""
    return s.filter(F.col("created") > F.lit(cutoff(as_of, lifetime))) \
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


def active_sessions(u: DataFrame, s: DataFrame, as_of: int, lifetime: int = 3600) -> DataFrame:
    """AGG-04: active sessions for every user; users without any -> 0."""
    return u.select("user_id").join(active_session_counts(s, as_of, lifetime), "user_id", "left") \
        .select("user_id", F.coalesce(F.col("sessions"), F.lit(0)).alias("active_sessions"))


def list_users(u: DataFrame, s: DataFrame, f: DataFrame, r: DataFrame, as_of: int,
               lifetime: int = 3600, lock_ttl: int = 300) -> DataFrame:
    """JON-04: the user overview (NULL, not 0, where a user has nothing)."""
    return (u.join(active_session_counts(s, as_of, lifetime), "user_id", "left")
            .join(author_summary(f, r), "user_id", "left")
            .select("user_id", "username", "admin", "verified", "disabled",
                    fmt_epoch("created").alias("created"),
                    lock_active("locked", as_of, lock_ttl).alias("locked"),
                    "sessions", "functions", "average"))


def top_rated(catalog: DataFrame, k: int) -> DataFrame:
    """SRT-01: the k best-rated catalog rows (unrated last, ties by id): TakeOrderedAndProject."""
    return catalog.orderBy(F.desc_nulls_last("average"), F.asc("function_id")).limit(k)


def page(df: DataFrame, sort: str, id_col: str, size: int, after=None, descending: bool = False) -> DataFrame:
    """SRT-02: keyset pagination on (sort, id); ``after`` = (sort, id) of the previous page's last
    row, or None for the first page.

    Rows without a sort value come last in either direction, so a value is followed by them and
    a missing value only by greater ids among them.  Ids ascend within equal values.
    """
    if after is not None:
        df = df.filter(beyond(sort, id_col, after, descending))
    return df.orderBy(*page_order(sort, id_col, descending)).limit(size)


def page_order(sort: str, id_col: str, descending: bool) -> list[Column]:
    """The order of a paged listing."""
    return [F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), F.asc(id_col)]


def beyond(sort: str, id_col: str, after, descending: bool) -> Column:
    """Whether a row comes after the key ``after`` = (sort value, id) in a paged listing."""
    (value, last), c, i = after, F.col(sort), F.col(id_col)
    if value is None:
        return c.isNull() & (i > F.lit(last))
    further = c < F.lit(value) if descending else c > F.lit(value)
    return further | ((c == F.lit(value)) & (i > F.lit(last))) | c.isNull()


def permissions(pairs: DataFrame, f: DataFrame, u: DataFrame) -> DataFrame:
    """PRJ-17: for (function_id, user_id=viewer) pairs: may_delete = owner or admin;
    may_rate = not owner.  Pairs on unknown functions are dropped (inner)."""
    authors = f.select("function_id", F.col("user_id").alias("author_id"))
    viewers = u.select("user_id", F.col("admin").alias("_viewer_admin"))
    j = pairs.join(authors, "function_id", "inner").join(viewers, "user_id", "left")
    owner = F.col("author_id") == F.col("user_id")
    return j.select(*pairs.columns, "author_id",
                    (owner | F.coalesce(F.col("_viewer_admin"), F.lit(False))).alias("may_delete"),
                    (~owner).alias("may_rate"))


def function_view(pairs: DataFrame, f: DataFrame, u: DataFrame, r: DataFrame) -> DataFrame:
    """AGG-07: the function page record for (function_id, user_id=viewer) pairs:
    details, keyword list, average (0 digits, unrated 0), own rating, permissions.

    One detail join (function + author name) and one per-(function, user) rating
    aggregate feed everything; the average is re-aggregated from that aggregate.
    """
    fd = f.select("function_id", F.col("user_id").alias("author_id"), "name", "usecase",
                  split_keywords(F.col("keywords")).alias("keyword_list")) \
        .join(u.select(F.col("user_id").alias("author_id"), "username"), "author_id", "inner")
    per_pair = r.groupBy("function_id", "user_id").agg(F.sum("value").alias("_own"),
                                                     F.count("value").alias("_n"))
    avg = per_pair.groupBy("function_id").agg(F.sum("_n").alias("_cnt"), F.sum("_own").alias("_tot")) \
        .select("function_id", round_half_up(exact_mean(F.col("_tot"), F.col("_cnt")), 0).alias("average"))
    viewers = u.select("user_id", F.col("admin").alias("_viewer_admin"))
    j = (pairs.join(fd, "function_id", "inner")
         .join(viewers, "user_id", "left")
         .join(avg, "function_id", "left")
         .join(per_pair.select("function_id", "user_id", "_own"), ["function_id", "user_id"], "left"))
    owner = F.col("author_id") == F.col("user_id")
    return j.select(*pairs.columns, "author_id",
                    (owner | F.coalesce(F.col("_viewer_admin"), F.lit(False))).alias("may_delete"),
                    (~owner).alias("may_rate"), "name", "usecase", "username", "keyword_list",
                    F.coalesce(F.col("average"), F.lit(0.0)).alias("average"),
                    F.coalesce(F.col("_own"), F.lit(0)).cast("bigint").alias("own_rating"))
