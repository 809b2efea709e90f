"""Epoch-second column helpers (PRJ-06, PRJ-11, PRJ-12).

All times are epoch seconds in ``bigint`` columns; timestamps appear only at
the edges, as zone-less values, so results do not depend on the session or
host time zone.  Cut-offs are computed as literals on the driver so that the
comparison ``col > literal`` pushes down into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def epoch_seconds(ts) -> Column:
    """Zone-less timestamp -> whole epoch seconds (floored)."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH_NTZ), _c(ts))


def cutoff(as_of: int, seconds: int) -> int:
    """PRJ-12: the trailing cut-off ``as_of - seconds``."""
    return int(as_of) - int(seconds)


def hours_ago(as_of: int, hours: int) -> int:
    """PRJ-12: the cut-off ``hours`` hours before ``as_of``."""
    return cutoff(as_of, hours * 3600)


def lock_active(locked, as_of, ttl: int = 300) -> Column:
    """PRJ-06: a lock holds while ``locked > as_of - ttl``; NULL and 0 mean unlocked."""
    c = _c(locked)
    return F.coalesce((c != 0) & (c > lit_or_col(as_of) - F.lit(ttl)), F.lit(False))


def fmt_epoch(c) -> Column:
    """PRJ-11: epoch seconds -> 'YYYY-MM-DD HH:MM:SS' in UTC."""
    ntz = F.timestamp_add("SECOND", _c(c), F.expr(_EPOCH_NTZ))
    return F.date_format(ntz, "yyyy-MM-dd HH:mm:ss")
