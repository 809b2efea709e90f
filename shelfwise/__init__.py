"""shelfwise: Spark jobs for a shared code library's data.

Tables of users, functions, ratings, sessions and account events are read as
DataFrames; every operator is a DataFrame -> DataFrame function that Catalyst
plans and the cluster executes.  Nothing reads the wall clock: each operator
that needs a time takes it as a parameter (``as_of``, epoch seconds).
"""

from shelfwise.session import get_session, scratch_path  # noqa: F401

__all__ = ["get_session", "scratch_path"]
