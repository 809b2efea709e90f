"""SRC-02 / SRC-03: inserts with column defaults, and event appends.

New ids are dense and follow the order of a unique key, as a SERIAL column
would after a sorted insert.  A global ``row_number()`` would move every row
into one task, so instead the rows are range-partitioned by the key, the
range of every row is pinned by writing it with the row (below the shared
``spark.checkpoint.dir``, so a lost executor cannot re-sample the ranges
differently), each range is numbered locally, and the ranges are offset by the
counts of the ranges before them (one small row per range).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfwise.session import checkpoint_table


def sequential_ids(df: DataFrame, order: Sequence[str], id_col: str, start: int = 1,
                   partitions: int | None = None, group: Sequence[str] = (), ranges: Sequence[str] | None = None) -> DataFrame:
    """Add ``id_col`` = start, start + 1, ... in ``order``; rows equal in it are numbered one after the other.

    ``ranges``: columns whose order agrees with ``order`` and that cut the ranges instead (short ones, as
    the bounds pass through the driver).

    With ``group`` the numbering restarts in every group.  A group may span
    several range partitions (a hot group is spread over many tasks); its
    offset in each partition is the count of its rows in earlier partitions.
    """
    spark = df.sparkSession
    group = list(group)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint_table(df.repartitionByRange(n, *group, *(ranges or order)).withColumn("_rp", F.spark_partition_id()))
    counts = ranged.groupBy("_rp", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    # One row per (range, group): at most `n` rows per group.
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not group:
        offsets = F.broadcast(offsets)   # exactly one row per range partition
    w = Window.partitionBy("_rp", *group).orderBy(*order)
    # Null-safe: rows without a group are a group.
    offsets = offsets.select(*[F.col(c).alias(f"_of_{c}") for c in ("_rp", *group)], "_off")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("_rp", *group)]
    return ranged.join(offsets, same) \
        .withColumn(id_col, F.lit(start) + F.col("_off") + F.row_number().over(w) - 1) \
        .select(*df.columns, id_col)


def insert_with_defaults(existing: DataFrame, new_rows: DataFrame, id_col: str, order: Sequence[str],
                         defaults: dict, as_of: int, created_col: str | None = "created") -> DataFrame:
    """SRC-02: the rows to append: missing/NULL columns take their defaults, ``created``
    takes ``as_of``, ids continue after the existing maximum in ``order``.

    Returns only the new rows (append them with ``write.mode('append')``).
    """
    start = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).first()["m"] + 1
    rows = new_rows
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    if created_col:
        rows = rows.withColumn(created_col, F.coalesce(F.col(created_col), F.lit(as_of))
                               if created_col in rows.columns else F.lit(as_of).cast("long"))
    return sequential_ids(rows, order, id_col, start)


def append_events(df: DataFrame, path: str, batch: str, partition_by: str = "event_type") -> None:
    """SRC-03: append event rows, partitioned by batch and type.

    A batch that is written again replaces its own rows instead of adding to them.  The rows are
    rebalanced by type first, so a type gets files of the advisory size, not one per task.
    """
    df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").partitionBy(partition_by) \
        .parquet(f"{path.rstrip('/')}/batch={batch}")


def with_event_reason(df: DataFrame) -> DataFrame:
    """SRC-03 defaults: ``reason`` is '' for login and create events, NULL otherwise."""
    reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    return df.withColumn("reason", F.coalesce(
        reason, F.when(F.col("event_type").isin("login", "create"), F.lit(""))))
