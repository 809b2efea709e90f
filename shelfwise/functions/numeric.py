"""Exact decimal means and rounding (AGG-01, AGG-05).

The reference's averages are exact numerics rounded half away from zero.  A
double ``avg`` cannot promise that, and ``avg`` of a small decimal keeps only
four extra digits, so a mean is formed as ``decimal(20,0) / decimal(20,0)``
(scale 18) and rounded once, at the end, with ``round`` (HALF_UP).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC_INT = "decimal(20,0)"


def exact_mean(total: Column, n: Column) -> Column:
    """``total / n`` as decimal(38,18); NULL when ``n`` is 0 or NULL."""
    return F.when(n > 0, total.cast(DEC_INT) / n.cast(DEC_INT))


def round_half_up(c: Column, digits: int) -> Column:
    """Round a decimal half away from zero and return it as double."""
    return F.round(c, digits).cast("double")
