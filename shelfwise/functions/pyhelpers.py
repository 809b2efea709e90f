"""Executor-side Python helper, applied as an Arrow-batched pandas UDF: decoding Python backslash
escapes, which Spark's built-in functions cannot express."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# A recognised escape, and one that is cut short.
ESCAPE_RX = re.compile(r"\\(?:[abfnrtv\\'\"\n]|[0-7]{1,3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|N\{[^}]+\})|\\(?=[xuUN]|\Z)")


def decode_escapes(s: str | None) -> str | None:
    """Decode Python backslash escapes; every other character, a backslash before anything else
    included, stays as it is.  None when an escape is cut short or names no character."""
    if s is None or "\\" not in s:
        return s
    try:
        return ESCAPE_RX.sub(_decoded, s)
    except UnicodeDecodeError:
        return None


def _decoded(m: re.Match) -> str:
    return codecs.decode(m[0], "unicode_escape")


def decode_escapes_udf(col: Column) -> Column:
    # Built on first use, so that importing this module on a Python worker needs no session.
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(decode_escapes, na_action="ignore")
    return run(col)
