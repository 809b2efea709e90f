"""A listing on disk whose pages are read from few files (SRT-02).

A page of a catalog sorted by its mean rating would aggregate all ratings each time.  ``Listing`` keeps
the rows as they were when it was built: range-partitioned in the listing's order, a folder ``range_no=<n>``
for each range, and beside them a small table with the rows and the last key of every range.  A page looks
its place up in that table and opens the ranges that can hold its rows, two where every range is longer than
a page.  Nothing but the bounds of these ranges, at most one more than a page has rows, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.catalog import beyond, page, page_order

RANGE, PLACE = "range_no", "_place"


class Listing:
    """Rows by (``sort``, ``id_col``), ids unique, rows without a sort value last; below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sort: str, id_col: str, descending: bool = False):
        clash = {RANGE, PLACE} & set(schema.names)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are the listing's own")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.sort, self.id_col, self.descending = sort, id_col, descending

    @classmethod
    def build(cls, rows: DataFrame, path: str, sort: str, id_col: str, descending: bool = False, ranges: int | None = None) -> Listing:
        """Write ``rows`` as a new listing of ``ranges`` ranges (default: the session's shuffle partitions)."""
        out = cls(rows.sparkSession, path, rows.schema, sort, id_col, descending)
        order = page_order(sort, id_col, descending)
        n = ranges or int(out.spark.conf.get("spark.sql.shuffle.partitions"))
        # The number that Spark gives a row holds its partition (31 bits) and its place in it (33 bits).
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PLACE, F.monotonically_increasing_id())
        dealt.withColumn(RANGE, F.shiftright(PLACE, 33).cast("int")).write.partitionBy(RANGE).parquet(f"{out.path}/rows")
        key = F.struct(F.col(sort).alias("value"), F.col(id_col).alias("id"))
        last = out._rows(PLACE).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), F.max_by(key, F.col(PLACE)).alias("last"))
        last.select(RANGE, "n", F.col("last.value").alias("value"), F.col("last.id").alias("id")) \
            .repartition(1).write.parquet(f"{out.path}/bounds")        # a row a range
        return out

    def _rows(self, *extra: str) -> DataFrame:
        own = {PLACE: T.LongType(), RANGE: T.IntegerType()}
        schema = T.StructType([*self.schema.fields, *[T.StructField(c, own[c]) for c in (*extra, RANGE)]])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def bounds(self) -> DataFrame:
        """(range_no, n, value, id): rows and last key of every range that has rows."""
        at = {f.name: f.dataType for f in self.schema.fields}
        schema = T.StructType([T.StructField(RANGE, T.IntegerType()), T.StructField("n", T.LongType()),
                               T.StructField("value", at[self.sort]), T.StructField("id", at[self.id_col])])
        return self.spark.read.schema(schema).parquet(f"{self.path}/bounds")

    def ranges_of(self, size: int, after=None) -> list[int]:
        """The ranges that hold the ``size`` rows that follow ``after``."""
        near = self.bounds()
        if after is not None:
            near = near.filter(beyond("value", "id", after, self.descending))
        out, rows = [], 0
        # Every range in this list has at least one row of the page, so size + 1 of them are enough.
        for i, r in enumerate(near.orderBy(RANGE).limit(size + 1).collect()):
            out.append(r[RANGE])
            rows += r["n"] if i or after is None else 1        # of the first, one row at least comes after
            if rows >= size:
                break
        return out

    def page(self, size: int, after=None) -> DataFrame:
        """The ``size`` rows that follow ``after`` = (sort value, id), or the first ones: as ``catalog.page``
        gives, from the files of the ranges that hold them (partition pruning: others are not opened)."""
        rows = self._rows().where(F.col(RANGE).isin(self.ranges_of(size, after))).drop(RANGE)
        return page(rows, self.sort, self.id_col, size, after, self.descending)

    def read(self) -> DataFrame:
        """All rows, in no promised order."""
        return self._rows().drop(RANGE)
