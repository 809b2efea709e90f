"""Files for point lookups: a list of keys opens the row groups that hold them (PRJ-05).

The files are sorted by the key, so the statistics of a row group bound its keys closely, and every row
group has a Bloom filter of them; the key is written without a dictionary, since Parquet would otherwise
leave the filter out.  A list of keys goes into the scan as a filter, which Parquet tests against both before
it reads a row group.  Longer lists are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.accounts import lookup

LIST_KEYS = 10_000         # keys that are gathered on the driver and put into a scan, at most
GROUP_BYTES = 8 << 20      # of a row group: the least that a lookup reads for one key


def write_for_lookup(df: DataFrame, path: str, key: str, files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Write ``df`` below ``path``, sorted by ``key`` in ``files`` files (default: the session's shuffle partitions)."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write \
        .option("parquet.block.size", str(group_bytes)) \
        .option("parquet.enable.dictionary#" + key, "false") \
        .option("parquet.bloom.filter.enabled#" + key, "true") \
        .option("parquet.bloom.filter.adaptive.enabled#" + key, "true") \
        .parquet(path)


def listed(table: DataFrame, keys: DataFrame, on: str, most: int = LIST_KEYS) -> DataFrame:
    """``table`` with the keys as a filter of its scan, if there are at most ``most`` different ones;
    otherwise ``table`` as it is.  Either way every row with one of the keys is in it."""
    few = [r[0] for r in keys.select(on).where(F.col(on).isNotNull()).distinct().limit(most + 1).collect()]
    return table if len(few) > most else table.where(F.col(on).isin(few))


def lookup_listed(table: DataFrame, keys: DataFrame, on: str, most: int = LIST_KEYS) -> DataFrame:
    """PRJ-05 from files: ``accounts.lookup``, reading the row groups that may hold a key."""
    return lookup(listed(table, keys, on, most), keys, on)
