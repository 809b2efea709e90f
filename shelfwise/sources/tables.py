"""SRC-01: scan the driver tables with fixed schemas, and the stand-in views.

The library's own tables (users, functions, ratings, sessions, account and
auth events) are defined as views over the driver's parquet tables, exactly as
FIXTURES.md section 3 states them, so that every query reads whole tables and
its work grows with them.  Each view is a lazy DataFrame: Catalyst prunes the
columns a query does not use down to the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.timecols import epoch_seconds

# Fixed clock of the stand-in data: 2024-01-30 23:59:59 UTC.
AS_OF = 1706659199

_L, _I, _D, _S, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
_TS = T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Fixed schemas of the driver tables (as written in the parquet files).
SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
    "embeddings": _schema(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-01: scan one table with its fixed schema (no schema inference job)."""
    return spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))


def _str(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------- stand-ins

def users(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("user_id"),
        F.concat(F.lit("customer"), F.lpad(_str(k), 9, "0"), F.lit("@"),
                 F.lower("c_mktsegment"), F.lit(".example")).alias("username"),
        (F.col("c_nationkey") == 0).alias("admin"),
        (F.col("c_acctbal") >= 0).alias("verified"),
        (k % 17 == 0).alias("disabled"),
        (F.lit(1704067200) + k * 60).alias("created"),
        F.when(k % 5 == 0, F.lit(AS_OF) - k % 600).alias("locked"),
    )


def functions(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    part = load(spark, d, "part")
    j = docs.join(part, docs.doc_id == part.p_partkey, "inner")
    return j.select(
        F.col("doc_id").alias("function_id"),
        (F.col("doc_id") % 97).alias("user_id"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"),
                 _str(F.col("doc_id"))).alias("name"),
        F.col("text").alias("code"),
        F.concat(F.lit("Use "), F.col("p_name"), F.lit(" at "), _str(F.col("p_size")),
                 F.when(F.col("p_size") % 2 == 0, F.lit("% load")).otherwise(F.lit(" pct_load"))
                 ).alias("usecase"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")), F.lit(", "),
                 F.lower("p_type"), F.lit(", "), F.col("lang"), F.lit(" ,"), F.col("lang")
                 ).alias("keywords"),
    )


def rating_log(spark: SparkSession, d: str) -> DataFrame:
    """Raw rating submissions, before validation: (seq, user_id, function_id, value)."""
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("function_id"),
        F.col("l_linenumber").alias("value"),
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """The ratings table: validated submissions, last write per (user, function) wins."""
    from shelfwise.operators.changes import latest_value

    log = rating_log(spark, d)
    f = functions(spark, d).select("function_id", F.col("user_id").alias("author_id"))
    ok = (log.filter(F.col("value").between(1, 5))
          .join(f, "function_id", "inner")
          .filter(F.col("user_id") != F.col("author_id"))
          .drop("author_id"))
    # seq ties within one (user, function) carry equal values (FIXTURES hazards), so the
    # hash-aggregated max_by is exact here.
    return latest_value(ok, ["user_id", "function_id"], "seq", ["value"], unique_order=True)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    return ev.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("session_id"), "user_id", epoch_seconds("ts").alias("created"))


def ip_of(user_id: str) -> Column:
    """The stand-in address of a user."""
    return F.concat(F.lit("10.0.0."), _str(F.col(user_id) % 50))


def account_events(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    return ev.filter(F.col("event_type").isin("signup", "purchase")).select(
        "event_id", "user_id", epoch_seconds("ts").alias("event_time"),
        F.when(F.col("event_type") == "signup", "create").otherwise("other").alias("event_type"),
        (F.col("value") >= 20).alias("success"),
        ip_of("user_id").alias("remote_ip"))


def auth_events(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    return ev.filter(F.col("event_type").isin("click", "view")).select(
        "event_id", "user_id", epoch_seconds("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", "login").otherwise("verification").alias("event_type"),
        (F.col("value") >= 20).alias("success"),
        ip_of("user_id").alias("remote_ip"))


def kv_log(spark: SparkSession, d: str) -> DataFrame:
    return kv_changes(load(spark, d, "events"))


def kv_changes(ev: DataFrame, *keep: str) -> DataFrame:
    """Session-state changes of events (a table or a stream): (seq, session_id, key, val), and the columns
    ``keep``; NULL val = delete."""
    return ev.select(
        *keep, F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"),
        F.concat(F.lit("k"), _str(F.col("event_id") % 5)).alias("key"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .otherwise(_str(F.col("event_id"))).alias("val"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Admin action log: (seq, action_time, user_id, action)."""
    ev = load(spark, d, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("seq"), epoch_seconds("ts").alias("action_time"), "user_id",
        F.when(et == "signup", "promote").when(et == "purchase", "disable")
         .when(et == "error", "lock").when(et == "view", "unlock").otherwise("enable")
         .alias("action"))


VIEWS = {
    "users": users, "functions": functions, "rating_log": rating_log, "ratings": ratings,
    "sessions": sessions, "account_events": account_events, "auth_events": auth_events,
    "kv_log": kv_log, "actions": actions,
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return VIEWS[name](spark, d)
