"""Account status, login, access decisions and admin actions
(PRJ-05..10, PRJ-13, PRJ-15, PRJ-16, PRJ-18).

The reference decides these one request at a time; here each is a column
expression over a table of requests, joined to users and sessions by key.
Every clock is a parameter: an ``int`` literal or a per-row ``Column``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import py_strip
from shelfwise.functions.timecols import lit_or_col, lock_active

# The reference's account status and login outcome strings
# (ok, unverified, rejected, invalid credentials) and its log text for unknown
# users.  The access decision labels are our names for the reference's branches.
STATUS_OK, STATUS_UNVERIFIED, STATUS_REJECTED = "ok", "unverified", "rejected"
LOGIN_INVALID = "invalid credentials"
LOG_UNKNOWN_USER = "Used does not exist"  # the reference's log text, spelled as it is there
ACCESS_INVALID, ACCESS_EXPIRED = "invalid", "expired"
ACCESS_ALLOW, ACCESS_VERIFY, ACCESS_SUSPENDED = "allow", "verify", "suspended"
SESSION_LIFETIME = 3600
LOCKOUT_DURATION = 300


def lookup(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """PRJ-05: batch point lookup: every key row, the matching row's columns, ``found``."""
    on = [on] if isinstance(on, str) else list(on)
    marked = df.withColumn("_found", F.lit(True))
    return keys.join(marked, on, "left") \
        .withColumn("found", F.coalesce(F.col("_found"), F.lit(False))).drop("_found")


def role(admin="admin") -> Column:
    """PRJ-09: 'admin' or 'user'."""
    a = F.col(admin) if isinstance(admin, str) else admin
    return F.when(a, F.lit("admin")).otherwise(F.lit("user"))


def status_col(disabled: Column, locked: Column, verified: Column, as_of,
               ttl: int = LOCKOUT_DURATION) -> Column:
    """PRJ-07 as an expression: disabled or lock active -> rejected; not verified -> unverified; else ok."""
    rejected = F.coalesce(disabled, F.lit(False)) | lock_active(locked, as_of, ttl)
    return (F.when(rejected, F.lit(STATUS_REJECTED))
            .when(~F.coalesce(verified, F.lit(False)), F.lit(STATUS_UNVERIFIED))
            .otherwise(F.lit(STATUS_OK)))


def account_status(u: DataFrame, as_of, ttl: int = LOCKOUT_DURATION) -> DataFrame:
    """PRJ-07: users with their ``status`` at ``as_of``."""
    return u.withColumn("status", status_col(F.col("disabled"), F.col("locked"),
                                             F.col("verified"), as_of, ttl))


def login_outcome(attempts: DataFrame, u: DataFrame, as_of,
                  ttl: int = LOCKOUT_DURATION) -> DataFrame:
    """PRJ-08: for attempts (user_id, credentials_ok, ...): reason, success, log_reason, log_user_id.

    A rejected account is rejected whatever the credentials; ok and unverified
    accounts get 'ok' or 'invalid credentials'; an unknown user gets 'invalid
    credentials' but is logged with its own reason and a NULL user.
    """
    us = u.select(F.col("user_id").alias("_uid"), F.col("disabled").alias("_dis"),
                  F.col("locked").alias("_lck"), F.col("verified").alias("_ver"))
    j = attempts.join(us, attempts.user_id == us._uid, "left")
    st = status_col(F.col("_dis"), F.col("_lck"), F.col("_ver"), as_of, ttl)
    known = F.col("_uid").isNotNull()
    creds = F.coalesce(F.col("credentials_ok"), F.lit(False))
    reason = (F.when(~known, F.lit(LOGIN_INVALID))
              .when(st == STATUS_REJECTED, F.lit(STATUS_REJECTED))
              .when(creds, F.lit(STATUS_OK)).otherwise(F.lit(LOGIN_INVALID)))
    return j.select(*attempts.columns, reason.alias("reason"), (reason == STATUS_OK).alias("success"),
                    F.when(known, reason).otherwise(F.lit(LOG_UNKNOWN_USER)).alias("log_reason"),
                    F.when(known, F.col("user_id")).alias("log_user_id"))


def access_decision(requests: DataFrame, s: DataFrame, u: DataFrame, as_of,
                    lifetime: int = SESSION_LIFETIME, ttl: int = LOCKOUT_DURATION) -> DataFrame:
    """PRJ-10: for requests (session_id, ...): invalid / expired / allow / verify / suspended.

    A session expires when ``created < as_of - lifetime`` (at exactly
    ``lifetime`` seconds it is still open).  ``as_of`` may be a column of
    ``requests`` (each request's own clock).
    """
    ss = s.select(F.col("session_id").alias("_sid"), F.col("user_id").alias("_suid"),
                  F.col("created").alias("_created"))
    us = u.select(F.col("user_id").alias("_uid"), F.col("disabled").alias("_dis"),
                  F.col("locked").alias("_lck"), F.col("verified").alias("_ver"))
    # Sessions find their users first: a request without a session would bring a NULL key to that join.
    owned = ss.join(us, F.col("_suid") == F.col("_uid"), "left")
    j = requests.join(owned, requests.session_id == F.col("_sid"), "left")
    clock = lit_or_col(as_of)
    st = status_col(F.col("_dis"), F.col("_lck"), F.col("_ver"), clock, ttl)
    decision = (F.when(F.col("_sid").isNull(), F.lit(ACCESS_INVALID))
                .when(F.col("_created") < clock - F.lit(lifetime), F.lit(ACCESS_EXPIRED))
                .when(F.col("_uid").isNull(), F.lit(ACCESS_INVALID))
                .when(st == STATUS_OK, F.lit(ACCESS_ALLOW))
                .when(st == STATUS_UNVERIFIED, F.lit(ACCESS_VERIFY))
                .otherwise(F.lit(ACCESS_SUSPENDED)))
    return j.select(*requests.columns, F.col("_suid").alias("session_user_id"),
                    decision.alias("decision"))


def client_ip(headers: Column, peer: Column) -> Column:
    """PRJ-13: the X-Forwarded-For header whole when present (even empty), else the peer."""
    return F.coalesce(F.element_at(headers, F.lit("X-Forwarded-For")), peer)


# A plain address shape: one '@', non-empty local part, a dotted domain, no spaces.
EMAIL_SHAPE_RX = r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"


def email_domain_ok(df: DataFrame, col: str, domains: Sequence[str]) -> DataFrame:
    """PRJ-15: (email_valid, domain, domain_ok, email_reason) for an address column.

    The normalised (lower-case) domain is compared with the allow-list as it stands, so an entry
    with capitals allows nothing.  Full RFC address validation is not reproduced; only the shape
    above is checked.
    """
    c = F.col(col)
    shape = F.coalesce(c.rlike(EMAIL_SHAPE_RX), F.lit(False))
    domain = F.when(shape, F.lower(F.substring_index(c, "@", -1)))
    ok = shape & F.coalesce(domain.isin(*domains), F.lit(False))
    reason = (F.when(~shape, F.lit("invalid address"))
              .when(~ok, F.lit("domain not allowed")).otherwise(F.lit("")))
    return df.select("*", shape.alias("email_valid"), domain.alias("domain"),
                     ok.alias("domain_ok"), reason.alias("email_reason"))


def norm_code(c: Column) -> Column:
    """PRJ-16: a typed verification code without spaces and dashes."""
    return F.translate(c, " -", "")


def fmt_code(c: Column) -> Column:
    """PRJ-16: a 6-character code shown as 'abc - def'."""
    return F.concat(F.substring(c, 1, 3), F.lit(" - "), F.substring(c, 4, 3))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode besides ASCII, and what each stands for."""
    found = [(chr(c), unicodedata.decimal(chr(c), None)) for c in range(128, sys.maxunicode + 1)]
    found = [(x, v) for x, v in found if v is not None]
    return "".join(x for x, _ in found), "".join(str(v) for _, v in found)


def parse_rating(c: Column) -> Column:
    """PRJ-18: a submitted rating text -> INT 1..5, else NULL (rejected).

    Accepts what ``int()`` does: white space and a sign around digits of any script, with single
    underscores between digits.
    """
    s = F.translate(py_strip(c), *_digits())
    v = F.when(s.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.regexp_replace(s, r"^\+|_", "").try_cast("decimal(38,0)"))
    return F.when(v.between(1, 5), v.cast("int"))
