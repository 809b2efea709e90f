"""Account-creation rate limits (AGG-06, WIN-02).

AGG-06 counts creations after a literal cut-off (pushed into the scan).

WIN-02 audits every creation with its trailing count (``event_time > t - span``)
in total and per address.  A naive ``count() OVER (ORDER BY t RANGE ...)`` has
no partition key for the total, so Spark would move every event into one task;
per address, one hot address would do the same.  Instead counts are taken per
distinct second first (the frame includes every event of the same second, so
the answer depends on the second only), and the trailing count is a
difference of prefix sums ``C(t) - C(t - span)``:

* ``C`` within a span-sized bucket is a running sum over distinct seconds,
  partitioned by (key, bucket): at most ``span`` rows per partition whatever
  the data volume;
* the bucket bases are prefix sums over per-(key, bucket) totals, a table
  bounded by the time range, not by the number of events;
* the probe point ``t - span`` is inserted as a zero-count row so that its
  prefix sum comes out of the same window.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfwise.functions.timecols import cutoff
from shelfwise.session import checkpoint_table

DAY = 86400
# The reference's creation limits (checked in this order).
TOTAL_LIMIT = 5
ADDRESS_LIMIT = 2
VERDICT_ALLOWED = "allowed"
VERDICT_TOTAL = "refused: total"
VERDICT_ADDRESS = "refused: address"


def recent_creates_total(ev: DataFrame, as_of: int, span: int = DAY) -> DataFrame:
    """AGG-06 total: creations with ``event_time > as_of - span`` (failed ones count too)."""
    return ev.filter((F.col("event_type") == "create") & (F.col("event_time") > F.lit(cutoff(as_of, span)))) \
        .agg(F.count(F.lit(1)).alias("creates"))


def recent_creates_by_ip(ev: DataFrame, as_of: int, span: int = DAY) -> DataFrame:
    """AGG-06 per address."""
    return ev.filter((F.col("event_type") == "create") & (F.col("event_time") > F.lit(cutoff(as_of, span)))) \
        .groupBy("remote_ip").agg(F.count(F.lit(1)).alias("creates"))


def trailing_counts(ev: DataFrame, keys: Sequence[str], t: str, span: int = DAY) -> DataFrame:
    """For every distinct (keys, t) of ``ev``: the number of rows of the same keys with
    time in ``(t - span, t]``.  Returns (keys..., t, trailing)."""
    keys = list(keys)
    per_sec = ev.groupBy(*keys, t).agg(F.count(F.lit(1)).alias("c"))
    # Real points and their probes (t - span, count 0) from one pass over per_sec.
    both = per_sec.select(*keys, F.inline(F.array(
        F.struct(F.col(t).alias(t), F.col("c").alias("c"), F.lit(True).alias("_real")),
        F.struct((F.col(t) - F.lit(span)).alias(t), F.lit(0).cast("bigint").alias("c"),
                 F.lit(False).alias("_real")))))
    # Bounded by distinct (keys, second) pairs; pinned once so that the window,
    # the bucket totals and the probe self-join below do not rescan the input.
    pts = both.groupBy(*keys, t).agg(F.sum("c").alias("c"), F.max("_real").alias("_real")) \
        .withColumn("_b", F.floor(F.col(t) / F.lit(span)))
    pts = checkpoint_table(pts, "seconds")
    # Running sum inside (keys, bucket): at most `span` rows per partition.
    w_in = Window.partitionBy(*keys, "_b").orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    run = pts.withColumn("_run", F.sum("c").over(w_in))
    # Bucket bases: exclusive prefix sums over per-(keys, bucket) totals (bounded by the time range).
    totals = pts.groupBy(*keys, "_b").agg(F.sum("c").alias("_bt"))
    w_b = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_b", F.coalesce(F.sum("_bt").over(w_b), F.lit(0)).alias("_base"))
    cum = run.join(bases, [*keys, "_b"], "inner") \
        .select(*keys, t, "_real", (F.col("_run") + F.col("_base")).alias("_cum"))
    now = cum.filter("_real").select(*keys, t, "_cum")
    before = cum.select(*keys, (F.col(t) + F.lit(span)).alias(t), F.col("_cum").alias("_cum_before"))
    return now.join(before, [*keys, t], "inner") \
        .select(*keys, t, (F.col("_cum") - F.col("_cum_before")).alias("trailing"))


def rate_limit_audit(ev: DataFrame, span: int = DAY, total_limit: int = TOTAL_LIMIT,
                     address_limit: int = ADDRESS_LIMIT) -> DataFrame:
    """WIN-02: each creation with its trailing total and per-address counts and the
    verdict the next attempt at that moment would get (total checked first)."""
    cr = ev.filter(F.col("event_type") == "create").select("event_id", "event_time", "remote_ip")
    tot = trailing_counts(cr, [], "event_time", span).withColumnRenamed("trailing", "total_24h")
    ip = trailing_counts(cr, ["remote_ip"], "event_time", span).withColumnRenamed("trailing", "ip_24h")
    out = cr.join(tot, "event_time", "inner").join(ip, ["remote_ip", "event_time"], "inner")
    verdict = (F.when(F.col("total_24h") >= total_limit, F.lit(VERDICT_TOTAL))
               .when(F.col("ip_24h") >= address_limit, F.lit(VERDICT_ADDRESS))
               .otherwise(F.lit(VERDICT_ALLOWED)))
    return out.select("event_id", "event_time", "remote_ip", "total_24h", "ip_24h", verdict.alias("verdict"))


ADMIT_SCHEMA = "event_id bigint, remote_ip string, event_time bigint, admitted boolean"


def admitted_ids(events: Iterable[tuple[int, int]], admitted: list[int], limit: int, span: int) -> list[int]:
    """Ids of the admitted among (time, id) events in order: admit while fewer than ``limit`` were
    admitted in the trailing ``span`` seconds; refused attempts do not count.  ``admitted`` holds the
    times so far and is kept up to date (never longer than ``limit``)."""
    out = []
    for t, i in events:
        admitted[:] = [a for a in admitted if a > t - span]
        if len(admitted) < limit:
            admitted.append(t)
            out.append(i)
    return out


def admit_batch(ev: DataFrame, limit: int = ADDRESS_LIMIT, span: int = DAY) -> DataFrame:
    """STR-06 batch twin: admission per address over a whole table.

    Of one address and second only the first ``limit`` events by id can be admitted, so the others are
    left out before the shuffle (a limited ranking).  What remains is sequential within an address:
    sorted by time, ``mapInPandas`` walks it keeping the last ``limit`` admitted times of the current
    address.  A join gives the flag back to all events.
    """
    cr = ev.filter(F.col("event_type") == "create").select("event_id", "remote_ip", "event_time")
    rank = F.row_number().over(Window.partitionBy("remote_ip", "event_time").orderBy("event_id"))
    few = cr.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")
    part = few.repartition("remote_ip").sortWithinPartitions("remote_ip", "event_time", "event_id")

    def run(batches):
        cur, admitted = None, []
        for pdf in batches:
            if pdf.empty:
                continue
            # Rows are sorted by address: split the batch into its address runs.
            starts = (pdf["remote_ip"] != pdf["remote_ip"].shift()).cumsum()
            for _, g in pdf.groupby(starts, sort=False):
                ip = g["remote_ip"].iat[0]
                if ip != cur:
                    cur, admitted = ip, []
                events = zip(g["event_time"].tolist(), g["event_id"].tolist())
                yield pd.DataFrame({"event_id": pd.array(admitted_ids(events, admitted, limit, span), dtype="int64")})

    yes = part.mapInPandas(run, "event_id bigint").withColumn("admitted", F.lit(True))
    return cr.join(yes, "event_id", "left").select("event_id", "remote_ip", "event_time", F.coalesce("admitted", F.lit(False)).alias("admitted"))
