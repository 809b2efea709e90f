"""Connected components of an edge table, by alternating star contraction.

Every round points each node's neighbours at the least node known (large star, then small star) and
writes the edges below the shared folder.  Minima are partial aggregates, so a hub costs no more
than one row a task; nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component, for every node that is not its own root.
    ``edges`` has two columns of one orderable type; loops and repeated edges do no harm."""
    a, b = edges.columns
    u, v = F.col("u"), F.col("v")
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v"))))
        small = large.join(low, "u").select(pairs.alias("e")).select("e.u", "e.v").where(u != v).distinct()
        now = written(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(u.alias("node"), v.alias("root"))
