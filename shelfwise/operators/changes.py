"""Writes and state changes on tables (WIN-01, DML-01..05).

Plain parquet has no MERGE, so each operator returns the *new* table; writing
it back is the caller's choice.  Last-write-wins is an aggregation of
``max(struct(order, values...))`` per key: a partial aggregate runs before the
shuffle, so a hot key (a third of all rows) is reduced map-side to one row per
task before it moves, and no task ever holds a whole group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_table


def latest_value(log: DataFrame, keys: Sequence[str], order: str | Sequence[str],
                 values: Sequence[str], unique_order: bool = False) -> DataFrame:
    """For each key keep the value columns of the row with the greatest ``order``.

    ``order`` may be several columns (compared left to right); ties on the
    whole order are broken by the value columns themselves (deterministic).
    With ``unique_order=True`` (one order column, unique within each key, or
    tied rows carrying equal values) ``max_by`` is used instead: for
    fixed-width columns that runs as a hash aggregate rather than a sort.
    """
    order = [order] if isinstance(order, str) else list(order)
    if unique_order and len(order) == 1:
        o = F.col(order[0])
        return log.groupBy(*keys).agg(*[F.max_by(F.col(v), o).alias(v) for v in values])
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values])
    agg = log.groupBy(*keys).agg(F.max(packed).alias("_latest"))
    return agg.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in order + list(values)]) \
        .drop(*[c for c in order if c not in values])


def latest_per_key(log: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """WIN-01: the latest whole row per key (all columns kept, ordering kept)."""
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in log.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    agg = log.groupBy(*keys).agg(F.max(packed).alias("_latest"))
    return agg.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in order + rest]) \
        .select(*log.columns)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str,
           values: Sequence[str], unique_order: bool = False) -> DataFrame:
    """DML-01: insert or replace by key; a change always wins over the current row,
    and among changes the greatest ``order`` wins (ON CONFLICT DO UPDATE, applied in order).

    ``order`` is an integer above the least long, which stands for the current row: source and order
    are one number.  ``unique_order``: no key has two changes of the same order, so fixed-width values
    run as a hash aggregate; else ties go to the greater values.
    """
    cur = current.select(*keys, F.lit(-(1 << 63)).cast("long").alias(order), *values)
    chg = changes.select(*keys, F.col(order).cast("long").alias(order), *values)
    return latest_value(cur.unionByName(chg), keys, order, list(values), unique_order)


# Admin actions -> (flag, value written).
ACTION_EFFECTS = {
    "promote": ("admin", True), "demote": ("admin", False),
    "disable": ("disabled", True), "enable": ("disabled", False),
    "verify": ("verified", True),
    "lock": ("locked", "time"), "unlock": ("locked", None),
}
FLAGS = ("admin", "disabled", "verified", "locked")


def apply_actions(u: DataFrame, actions: DataFrame) -> DataFrame:
    """DML-02: apply an admin action log (seq, action_time, user_id, action) to users.

    The last action per (user, flag) wins; lock writes the action time, unlock
    writes NULL (kept as a set value, not mistaken for 'no action').  One
    aggregation per user with a ``max(struct)`` per flag, then one left join.
    """
    flag = F.lit(None).cast("string")
    bval = F.lit(None).cast("boolean")
    lval = F.lit(None).cast("long")
    a = F.col("action")
    for name, (fl, val) in ACTION_EFFECTS.items():
        flag = F.when(a == name, F.lit(fl)).otherwise(flag)
        if isinstance(val, bool):
            bval = F.when(a == name, F.lit(val)).otherwise(bval)
        elif val == "time":
            lval = F.when(a == name, F.col("action_time")).otherwise(lval)
    act = actions.select("user_id", "seq", flag.alias("flag"), bval.alias("b"), lval.alias("l")) \
        .filter(F.col("flag").isNotNull())
    last = act.groupBy("user_id").agg(*[
        F.max(F.when(F.col("flag") == fl, F.struct("seq", "b", "l"))).alias(f"_{fl}") for fl in FLAGS])
    j = u.join(last, "user_id", "left")
    cols = []
    for c in u.columns:
        if c in ("admin", "disabled", "verified"):
            cols.append(F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.b")).otherwise(F.col(c)).alias(c))
        elif c == "locked":
            cols.append(F.when(F.col("_locked").isNotNull(), F.col("_locked.l")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def delete_returning(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """DML-04: (kept, deleted) rows of ``df`` for the given keys."""
    on = [on] if isinstance(on, str) else list(on)
    k = keys.select(*on).distinct()
    return df.join(k, on, "left_anti"), df.join(k, on, "left_semi")


def cascade_delete(tables: dict[str, DataFrame], user_ids: DataFrame | None = None,
                   function_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """DML-03: delete users and/or functions with the schema's ON DELETE CASCADE.

    A user takes its functions, sessions, both event logs and ratings, and the
    ratings on its functions; a function takes its ratings.  Log rows with a
    NULL user stay (anti-join on NULL keys keeps them).  The deleted keys are
    derived once, written, and shared by all tables.
    """
    out = dict(tables)
    uid = checkpoint_table(user_ids.select("user_id").distinct(), "gone-users") if user_ids is not None else None
    if uid is not None:
        for name in ("users", "sessions", "account_events", "auth_events", "functions", "ratings"):
            if name in out:
                out[name] = out[name].join(uid, "user_id", "left_anti")
    gone = None
    if "functions" in tables:
        parts = []
        if uid is not None:
            parts.append(tables["functions"].join(uid, "user_id", "left_semi").select("function_id"))
        if function_ids is not None:
            parts.append(function_ids.select("function_id"))
        if parts:
            gone = parts[0]
            for p in parts[1:]:
                gone = gone.unionByName(p)
            gone = checkpoint_table(gone.distinct(), "gone-functions")
            out["functions"] = out["functions"].join(gone, "function_id", "left_anti")
    elif function_ids is not None:
        gone = checkpoint_table(function_ids.select("function_id").distinct(), "gone-functions")
    if gone is not None and "ratings" in out:
        out["ratings"] = out["ratings"].join(gone, "function_id", "left_anti")
    return out


def fold_state(log: DataFrame, session: str = "session_id", key: str = "key",
               order: str = "seq", val: str = "val") -> DataFrame:
    """DML-05: session contents as rows (session, key, val): the last write per key,
    deleted keys (last write NULL) removed."""
    last = latest_value(log, [session, key], order, [val])
    return last.filter(F.col(val).isNotNull())


def state_map(state: DataFrame, session: str = "session_id", key: str = "key",
              val: str = "val") -> DataFrame:
    """DML-05 map form: one MapType column per session (keys sorted).

    A session's dictionary is bounded (the reference caps it below 100 kB), so
    collecting it per session is safe.
    """
    return state.groupBy(session).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, val)))).alias("data"))
