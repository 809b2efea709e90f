"""Text column expressions (PRJ-01/02/04/14, TXT-15).

Python's ``str.strip`` removes every Unicode white-space character, Spark's
``trim`` only spaces; ``py_strip`` reproduces the former with one regex.
``splitlines`` reproduces Python's line boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (Python semantics that must be matched exactly):
# white space removed by str.strip, and the line boundaries of str.splitlines.
PY_STRIP_RX = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
PY_LINE_RX = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Line boundaries other than a plain newline (rare in practice).
RARE_BREAK_RX = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no argument."""
    return F.regexp_replace(_c(c), PY_STRIP_RX, "")


def contains_ci(c, term) -> Column:
    """Case-insensitive literal substring test (an empty term matches every non-null)."""
    t = term if isinstance(term, Column) else F.lit(term)
    return F.contains(F.lower(_c(c)), F.lower(t))


def split_line_parts(c) -> Column:
    """The raw line split (Python's boundaries); ``drop_trailing_empty`` completes ``splitlines``."""
    c = _c(c)
    # Texts with only '\n' breaks take the single-character split (no regex engine).
    return F.when(c.rlike(RARE_BREAK_RX), F.split(c, PY_LINE_RX, -1)).otherwise(F.split(c, "\n", -1))


def drop_trailing_empty(parts) -> Column:
    parts = _c(parts)
    n = F.size(parts)
    return F.when((n > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, n - 1)).otherwise(parts)


def split_lines(c) -> Column:
    """Python ``str.splitlines()``: split on line boundaries, drop one trailing empty item.

    (In a hot path, project ``split_line_parts`` first and apply ``drop_trailing_empty``
    on top, so the split is computed once per row.)
    """
    return drop_trailing_empty(split_line_parts(c))


def split_keywords(c) -> Column:
    """PRJ-14 view path: split on ',' and strip each item (order and duplicates kept)."""
    return F.transform(F.split(_c(c), ",", -1), lambda x: py_strip(x))


def normalise_keywords(c) -> Column:
    """PRJ-14 save path: split, strip, de-duplicate, join with ', ' (sorted for determinism)."""
    return F.array_join(F.array_sort(F.array_distinct(split_keywords(c))), ", ")


def highlight(c, term: str) -> Column:
    """PRJ-04: wrap each case-insensitive literal occurrence of ``term`` in <mark>."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(_c(c), F.lit("(?i)" + quoted), F.lit("<mark>$0</mark>"))


def nl_to_br(c) -> Column:
    """TXT-15: newlines to line-break tags."""
    return F.replace(_c(c), F.lit("\n"), F.lit("<br>"))
