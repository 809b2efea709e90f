"""Boundary fixtures for text helpers, clocks and account decisions."""

from pyspark.sql import functions as F

from shelfwise.functions.text import contains_ci, highlight, normalise_keywords, py_strip, split_lines
from shelfwise.functions.timecols import fmt_epoch, lock_active
from shelfwise.operators import accounts as A

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_py_strip_matches_python_on_every_whitespace(spark):
    rows = [(f"{w}a{w}b{w}",) for w in WS]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(py_strip("s")).collect()]
    assert got == [s.strip() for (s,) in rows]


def test_split_lines_matches_python(spark):
    samples = ["a\nb", "a\r\nb\r\n", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h i j", "", "\n", "x\n\n", "end"]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(split_lines("s").alias("l")).collect()
    assert [r.l for r in got] == [s.splitlines() for s in samples]


def test_search_is_literal_and_case_insensitive(spark):
    df = spark.createDataFrame([("50% load",), ("5 pct_load",), ("a\\b",), (None,), ("ABC",)], "s string")
    hits = lambda t: [r.s for r in df.filter(contains_ci("s", t)).collect()]
    assert hits("%") == ["50% load"]
    assert hits("_") == ["5 pct_load"]
    assert hits("\\") == ["a\\b"]
    assert hits("abc") == ["ABC"]
    assert hits("") == ["50% load", "5 pct_load", "a\\b", "ABC"]


def test_highlight_quotes_the_term(spark):
    df = spark.createDataFrame([("x.y X.Y xay",), ("a\\Eb A\\EB",)], "s string")
    assert df.select(highlight(F.col("s"), "x.y")).first()[0] == "<mark>x.y</mark> <mark>X.Y</mark> xay"
    assert df.select(highlight(F.col("s"), "a\\Eb")).collect()[1][0] == "<mark>a\\Eb</mark> <mark>A\\EB</mark>"


def test_normalise_keywords(spark):
    df = spark.createDataFrame([(" b, a ,b,, a",)], "s string")
    assert df.select(normalise_keywords("s")).first()[0] == ", a, b"


def test_lock_boundary_and_zero(spark):
    as_of = 1_000_000
    df = spark.createDataFrame([(as_of - 300,), (as_of - 299,), (0,), (None,), (as_of + 5,)], "locked bigint")
    got = [r[0] for r in df.select(lock_active("locked", as_of)).collect()]
    assert got == [False, True, False, False, True]


def test_fmt_epoch_is_utc(spark):
    df = spark.createDataFrame([(0,), (1706659199,)], "t bigint")
    assert [r[0] for r in df.select(fmt_epoch("t")).collect()] == ["1970-01-01 00:00:00", "2024-01-30 23:59:59"]


def test_access_decision_boundaries(spark):
    as_of = 10_000
    u = spark.createDataFrame([(1, False, None, True), (2, False, None, False), (3, True, None, True),
                               (4, False, as_of - 10, True)],
                              "user_id bigint, disabled boolean, locked bigint, verified boolean")
    s = spark.createDataFrame([(10, 1, as_of - 3600), (11, 1, as_of - 3601), (12, 2, as_of), (13, 3, as_of),
                               (14, 4, as_of), (15, 99, as_of)], "session_id bigint, user_id bigint, created bigint")
    req = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14, 15, 16)], "session_id bigint")
    got = {r.session_id: r.decision for r in A.access_decision(req, s, u, as_of).collect()}
    assert got == {10: "allow", 11: "expired", 12: "verify", 13: "suspended", 14: "suspended",
                   15: "invalid", 16: "invalid"}


def test_login_outcomes(spark):
    u = spark.createDataFrame([(1, False, None, True), (2, False, None, False), (3, True, None, True)],
                              "user_id bigint, disabled boolean, locked bigint, verified boolean")
    att = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True), (4, 3, True), (5, 9, True)],
                                "attempt_id bigint, user_id bigint, credentials_ok boolean")
    got = {r.attempt_id: (r.reason, r.success, r.log_reason, r.log_user_id)
           for r in A.login_outcome(att, u, 0).collect()}
    assert got == {1: ("ok", True, "ok", 1), 2: ("invalid credentials", False, "invalid credentials", 1),
                   3: ("ok", True, "ok", 2), 4: ("rejected", False, "rejected", 3),
                   5: ("invalid credentials", False, A.LOG_UNKNOWN_USER, None)}


def test_parse_rating(spark):
    texts = [" 3 ", "+2", "-1", "0", "5", "6", "4.0", "1_0", "x", None, "\t1\n", "0_5", "0__5", "_5", "\u0663", "\uff14", "9" * 60, "0" * 30 + "4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(A.parse_rating(F.col("t"))).collect()]
    assert got == [3, 2, None, None, 5, None, None, None, None, None, 1, 5, None, None, 3, 4, None, 4]


def test_client_ip(spark):
    df = spark.sql("SELECT map('X-Forwarded-For', '1.2.3.4') h, '9.9.9.9' p UNION ALL "
                   "SELECT map('X-Forwarded-For', '') h, '9.9.9.9' p UNION ALL "
                   "SELECT map('Accept', 'x') h, '9.9.9.9' p")
    assert [r[0] for r in df.select(A.client_ip(F.col("h"), F.col("p"))).collect()] == ["1.2.3.4", "", "9.9.9.9"]
