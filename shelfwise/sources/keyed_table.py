"""A table on disk, dealt to folders by a hash of its key, that changes are written into (DML-01, DML-02).

Plain Parquet has no MERGE.  ``KeyedTable`` keeps rows in ``bucket=<n>`` folders; an update reads and
writes only the buckets that a change hits, so its cost follows the changes, and the files of the others
stay as they are.  The new buckets are first written aside, then take the place of the old ones by dynamic
partition overwrite.  An update that failed half-way can be run again with the same changes: an upsert or
an action log has the same result on a row that already has it, and ``replace`` takes the copy written aside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.changes import apply_actions, upsert
from shelfwise.session import checkpoint_table

BUCKET = "bucket"


class KeyedTable:
    """Rows with unique ``keys`` in ``buckets`` folders below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int):
        if BUCKET in schema.names:
            raise ValueError(f"column {BUCKET} is the table's own")
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> KeyedTable:
        """Write ``rows`` as a new table."""
        t = cls(rows.sparkSession, path, rows.schema, keys, buckets)
        t._write(t._dealt(rows), "errorifexists")
        return t

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumn(BUCKET, self.bucket())

    def _write(self, dealt: DataFrame, mode: str) -> None:
        """A bucket's rows go to few tasks, of the advisory size; a large bucket is split."""
        dealt.hint("rebalance", F.col(BUCKET)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self, touched: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets (partition pruning: other folders are not opened)."""
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(whole).parquet(self.path)
        if touched is not None:
            rows = rows.where(F.col(BUCKET).isin(list(touched)))
        return rows.drop(BUCKET)

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that ``changes`` hit: at most ``buckets`` numbers."""
        return sorted(r[BUCKET] for r in changes.select(self.bucket().alias(BUCKET)).distinct().collect())

    def change(self, changes: DataFrame, new: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``new(their rows, changes)``; returns their numbers."""
        changes = checkpoint_table(changes, "changes")
        hit = self.touched(changes)
        if hit:
            self.replace(checkpoint_table(self._dealt(new(self.read(hit), changes)), "buckets"))
        return hit

    def replace(self, dealt: DataFrame) -> None:
        self._write(dealt, "overwrite")

    def upsert(self, changes: DataFrame, order: str, unique_order: bool = False) -> list[int]:
        """DML-01 in place: insert or replace by key, the greatest ``order`` last."""
        values = [c for c in self.schema.names if c not in self.keys]
        return self.change(changes, lambda now, some: upsert(now, some, self.keys, order, values, unique_order))

    def apply_actions(self, actions: DataFrame) -> list[int]:
        """DML-02 in place, for a table of users by ``user_id``."""
        return self.change(actions, apply_actions)
