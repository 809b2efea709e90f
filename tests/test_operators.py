"""Boundary fixtures for ratings, windows, changes, search paths and reports."""

import random

import pandas as pd
from pyspark.sql import functions as F

from shelfwise.functions import pyhelpers as PH
from shelfwise.operators import accounts as A
from shelfwise.operators import catalog as C
from shelfwise.operators import changes as CH
from shelfwise.operators import rates as R
from shelfwise.operators import reports as RP
from shelfwise.operators import search as S
from shelfwise.sources import writers as W


def test_exact_half_up_rounding(spark):
    r = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (2, 2), (2, 3), (3, 1), (3, 2), (3, 2), (3, 2),
                               (3, 2), (3, 2), (3, 2), (3, 2)], "function_id bigint, value int")
    got = {x.function_id: (x.average_0, x.average_1, x.average_2) for x in C.avg_rating(r, [0, 1, 2]).collect()}
    # 1.5 -> 2 ; 2.25 -> 2.3 (half up, not to even) ; 1.875 -> 1.88
    assert got == {1: (2.0, 1.5, 1.5), 2: (2.0, 2.3, 2.25), 3: (2.0, 1.9, 1.88)}


def test_null_versus_zero(spark):
    f = spark.createDataFrame([(1, 7, "n1", "u", "k"), (2, 7, "n2", "u", "k")],
                              "function_id bigint, user_id bigint, name string, usecase string, keywords string")
    u = spark.createDataFrame([(7, "x", False, True, False, 0, None), (8, "y", False, True, False, 0, None)],
                              "user_id bigint, username string, admin boolean, verified boolean, disabled boolean, "
                              "created bigint, locked bigint")
    r = spark.createDataFrame([(1, 9, 4)], "function_id bigint, user_id bigint, value int")
    s = spark.createDataFrame([], "session_id bigint, user_id bigint, created bigint")
    cat = {x.function_id: x.average for x in C.list_functions(f, u, r).collect()}
    assert cat == {1: 4.0, 2: None}
    zero = {x.function_id: x.average for x in C.avg_rating_or_zero(f.select("function_id"), r).collect()}
    assert zero == {1: 4.0, 2: 0.0}
    lu = {x.user_id: (x.sessions, x.functions, x.average) for x in C.list_users(u, s, f, r, 100).collect()}
    assert lu == {7: (None, 2, 4.0), 8: (None, None, None)}


def _naive_trailing(times, span):
    return [sum(1 for s in times if t - span < s <= t) for t in times]


def test_trailing_counts_equal_naive_window(spark):
    rnd = random.Random(7)
    span = 86400
    base = [rnd.randrange(0, 10 * span) for _ in range(400)]
    base += [span * 3, span * 4, span * 4, span * 5 - 1, span * 5]   # exact boundaries and same-second peers
    ips = [f"ip{rnd.randrange(3)}" for _ in base]
    df = spark.createDataFrame(list(zip(range(len(base)), base, ips)), "event_id bigint, t bigint, ip string")
    tot = {x.t: x.trailing for x in R.trailing_counts(df, [], "t", span).collect()}
    assert all(tot[t] == n for t, n in zip(base, _naive_trailing(base, span)))
    per = {(x.ip, x.t): x.trailing for x in R.trailing_counts(df, ["ip"], "t", span).collect()}
    for ip in set(ips):
        ts = [t for t, i in zip(base, ips) if i == ip]
        assert all(per[(ip, t)] == n for t, n in zip(ts, _naive_trailing(ts, span)))


def test_admission_refused_do_not_count(spark):
    ev = spark.createDataFrame([(1, 0, "a"), (2, 10, "a"), (3, 20, "a"), (4, 86401, "a"), (5, 86411, "a"),
                                (6, 5, "b")], "event_id bigint, event_time bigint, remote_ip string") \
        .withColumn("event_type", F.lit("create"))
    got = {x.event_id: x.admitted for x in R.admit_batch(ev).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_upsert_and_latest(spark):
    cur = spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "user_id bigint, function_id bigint, value int")
    chg = spark.createDataFrame([(1, 1, 10, 5), (1, 1, 9, 1), (2, 1, 1, 2)],
                                "user_id bigint, function_id bigint, seq bigint, value int")
    got = {(x.user_id, x.function_id): x.value
           for x in CH.upsert(cur, chg, ["user_id", "function_id"], "seq", ["value"]).collect()}
    assert got == {(1, 1): 5, (1, 2): 4, (2, 1): 2}


def test_apply_actions_unlock_writes_null(spark):
    u = spark.createDataFrame([(1, False, True, False, 50), (2, False, True, False, None)],
                              "user_id bigint, admin boolean, verified boolean, disabled boolean, locked bigint")
    a = spark.createDataFrame([(1, 100, 1, "lock"), (2, 110, 1, "unlock"), (3, 120, 2, "promote"),
                               (4, 130, 2, "lock"), (5, 140, 2, "disable"), (6, 150, 2, "enable")],
                              "seq bigint, action_time bigint, user_id bigint, action string")
    got = {x.user_id: (x.admin, x.disabled, x.locked) for x in CH.apply_actions(u, a).collect()}
    assert got == {1: (False, False, None), 2: (True, False, 130)}


def test_cascade_keeps_null_log_users(spark):
    t = {"users": spark.createDataFrame([(1,), (2,)], "user_id bigint"),
         "functions": spark.createDataFrame([(10, 1), (20, 2)], "function_id bigint, user_id bigint"),
         "account_events": spark.createDataFrame([(1, 1), (2, None), (3, 2)], "event_id bigint, user_id bigint"),
         "ratings": spark.createDataFrame([(2, 10, 5), (2, 20, 4), (1, 20, 3)],
                                          "user_id bigint, function_id bigint, value int")}
    out = CH.cascade_delete(t, spark.createDataFrame([(1,)], "user_id bigint"))
    assert sorted(r.event_id for r in out["account_events"].collect()) == [2, 3]
    assert [(r.user_id, r.function_id) for r in out["ratings"].collect()] == [(2, 20)]
    assert [r.function_id for r in out["functions"].collect()] == [20]


def test_fold_state_drops_tombstones(spark):
    log = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", None), (3, 1, "b", "y"), (4, 1, "b", "z")],
                                "seq bigint, session_id bigint, key string, val string")
    m = CH.state_map(CH.fold_state(log)).first()
    assert dict(m.data) == {"b": "z"}


def test_sequential_ids_follow_key_order(spark):
    rows = [(f"name{i:05d}",) for i in random.Random(3).sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "username string")
    out = W.sequential_ids(df, ["username"], "user_id", start=101, partitions=7).collect()
    got = sorted((r.user_id, r.username) for r in out)
    assert [i for i, _ in got] == list(range(101, 101 + 3000))
    assert [n for _, n in got] == sorted(n for (n,) in rows)


def test_search_many_equals_a_test_of_every_pair(spark):
    rows = [(1, "Alpha, beta", "use a%b", "x = 'Gamma'\nbeta"), (2, "z", "q_q", "ALPHABET"), (3, None, "", "be")]
    f = spark.createDataFrame(rows, "function_id bigint, keywords string, usecase string, code string")
    terms = ["alpha", "Alpha", "be", "a", "%b", "q_", "", "gamma", "zz", "bet", None, "be"]
    got = sorted(tuple(r) for r in S.search_many(f, spark.createDataFrame([(t,) for t in terms], "term string")).collect())
    want = sorted((t, r[0], n) for t in set(terms) - {None} for r in rows for n, x in zip(S.FIELDS, r[1:])
                  if x is not None and t.lower() in x.lower())
    assert got == want
    assert S.search_many(f, spark.createDataFrame([], "term string")).count() == 0


def test_search_many_in_several_scans_and_with_long_terms(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abé漢 ", k=rng.randint(0, 60))) for _ in range(60)] + ["é" * 40, "ab" * 3000, None, ""]
    f = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "function_id bigint, code string").repartition(3)
    terms = sorted({t[a:a + n] for t in texts if t for a in range(0, min(len(t), 40), 5) for n in (1, 2, 3, 5, 8, 9, 12, 30, 200)} | {"É", "AB", "zz", "ab" * 2000, ""})
    want = sorted((t, i, "code") for t in terms for i, x in enumerate(texts) if x is not None and t.lower() in x.lower())
    for block in (1 << 18, 200):
        out = S.search_many(f, spark.createDataFrame([(t,) for t in terms], "term string"), ["code"], terms_a_scan=block)
        assert sorted(map(tuple, out.collect())) == want


def test_search_many_moves_no_text(spark, sf_dir):
    """Texts reach the scan's Python stage and nothing else: no exchange below it or of a text above it."""
    from shelfwise.sources.tables import view
    out = S.search_many(view(spark, sf_dir, "functions"), spark.createDataFrame([("the",), ("nothing like it",)], "term string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInArrow"):plan.index("Scan parquet", plan.index("MapInArrow"))]
    assert "Exchange" not in scan and plan.count("MapInArrow") == 1
    assert not any("ltext" in line for line in plan.splitlines() if "Exchange" in line or "Join" in line)


def test_parse_keywords_strictness(spark):
    cases = {'["a", "b", "a"]': (True, ["a", "b"]), "[]": (True, []), "[null]": (False, None),
             "['a']": (False, None), '["a", 1]': (False, None), '"a"': (False, None), "not json": (False, None),
             '["a"] xyz': (False, None), "[]x": (False, None), '["a"]["b"]': (False, None), '["a"], ["b"]': (False, None),
             '["a"]], [["b"]': (False, None), '["a"], "w": 1': (False, None),
             '{"a": "b"}': (False, None), '["a", null]': (False, None), ' [ "x" ] ': (True, ["x"])}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    valid, arr = RP.parse_keywords("j")
    got = {r.j: (r.v, r.a) for r in df.select("j", valid.alias("v"), arr.alias("a")).collect()}
    assert got == cases


def test_extract_code_and_escapes(spark):
    replies = ["x ```python\n  code\\tx\n``` y", "no fence", "```a```b```c```", "```bad \\```"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [(x.code, x.status) for x in RP.extract_code(df, "r").collect()]
    assert got == [("code\tx", "ok"), (None, "no code"), ("a", "ok"), (None, "bad escape")]
    assert PH.decode_escapes("café \\n") == "café \n"


def test_escapes():
    cases = {"a\\tb": "a\tb", "\\x41\\u017c\\101\\N{BULLET}": "A\u017cA\u2022", "\\\u017cb": "\\\u017cb", "\\q\u017c": "\\q\u017c",
             "\\\\n": "\\n", "\\x4": None, "\\u12": None, "tail\\": None, "\\N{no such name}": None, "plain": "plain"}
    assert {k: PH.decode_escapes(k) for k in cases} == cases


def test_paging_reaches_every_row_in_both_directions(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, average double")
    for down in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0]))
        got, after = [], None
        while page := [tuple(r) for r in C.page(df, "average", "id", 7, after, down).collect()]:
            got += page
            after = (page[-1][1], page[-1][0])
        assert got == want


def test_test_results_variants(spark):
    reps = ['{"total": 4, "failures": ["f"], "errors": ["e"], "skipped": [], "successful": false}',
            '{"total": 2, "failures": [], "errors": [], "skipped": [], "successful": false}',
            '{"error": "Unhandled"}', '{"error": null, "payload": {"errorMessage": "m"}}', '{"total": 3, "failures": [], "successful": true}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reps)], "file_id bigint, report string")
    page = {x.file_id: (x.ok, x.fail, x.messages) for x in RP.test_results(df, "page").collect()}
    assert page == {0: (1, 3, "f\ne"), 1: (1, 1, RP.RUN_FAILED), 2: (0, 1, RP.RUN_FAILED),
                    3: (0, 1, RP.RUN_FAILED), 4: (0, 1, RP.RUN_FAILED)}
    handle = {x.file_id: (x.executed, x.ok, x.errors, x.failures, x.skipped) for x in RP.test_results(df, "handle").collect()}
    assert handle == {0: (4, 2, ["e"], ["f"], []), 1: (2, 2, [], [], []), 2: (0, None, ["Unhandled"], None, None),
                      3: (0, None, ["None: m"], None, None), 4: (3, 3, [], [], [])}


def test_marker_range(spark):
    df = spark.createDataFrame([("3", "None", "None", "None"), ("1", "4", "2", "9")], "a string, b string, c string, d string")
    got = [(x.start_row, x.start_column, x.end_row, x.end_column) for x in RP.marker_range(df, "a", "b", "c", "d").collect()]
    assert got == [(2, 2, 2, RP.INFINITY_COL), (0, 4, 1, 9)]


def test_pandas_helpers_are_plain_functions():
    s = pd.Series(["a\\nb", None])
    assert s.map(PH.decode_escapes, na_action="ignore").tolist()[0] == "a\nb"


def test_grouped_sequential_ids_split_hot_group(spark):
    rows = [(1, t) for t in range(3000)] + [(g, t) for g in range(2, 40) for t in range(5)]
    df = spark.createDataFrame(rows, "g bigint, t bigint")
    out = W.sequential_ids(df, ["t"], "pos", start=1, partitions=8, group=["g"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.t, r.pos))
    for g, pairs in by.items():
        pairs.sort()
        assert [p for _, p in pairs] == list(range(1, len(pairs) + 1)), g


def test_every_turn_of_a_conversation_has_a_place(spark):
    """Null turns, turns sent twice and turns without a conversation keep their rows."""
    rows = [(1, None, "u", "a"), (1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "u", "w"), (1, 3, "u", "last"), (2, 5, "u", None),
            (None, 1, "u", "lost"), (None, None, "u", "lost too")] + [(3, t % 40, "u", f"{t:040d}") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {}
    for r in RP.conversation_messages(df).collect():
        got.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["content"]))
    nulls_first = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    for conv in (1, 2, 3, None):
        want = sorted((r[1:] for r in rows if r[0] == conv), key=nulls_first)
        assert sorted(got[conv]) == [(i + 1, role, text) for i, (_, role, text) in enumerate(want)]


def test_payload_members_count_by_their_key(spark):
    reports = ['{"error": "U", "payload": {"errorType": null, "errorMessage": "m"}}', '{"error": "U", "payload": {"errorType": "T", "errorMessage": null}}',
               '{"error": "U", "payload": {"errorMessage": null}}', '{"error": "U", "payload": {}}', '{"error": "U"}']
    df = spark.createDataFrame(list(enumerate(reports)), "file_id bigint, report string")
    got = {r.file_id: r.errors for r in RP.test_results(df, "handle").collect()}
    assert got == {0: ["U: None: m"], 1: ["U: T: None"], 2: ["U: None"], 3: ["U"], 4: ["U"]}


def test_digits_of_every_script(spark):
    import unicodedata
    texts = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"] + ["\U0001D7D1\U0001D7CE", "²", "½", "\U0001F103"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", A.parse_rating(F.col("t")).alias("v")).collect():
        try:
            n = int(r["t"])
        except ValueError:
            n = None
        assert r["v"] == (n if n is not None and 1 <= n <= 5 else None), r["t"]


def test_unique_compares_values_only_where_fingerprints_repeat(spark, monkeypatch):
    """Also when different values share a fingerprint, and without a value in the first shuffle."""
    from shelfwise.operators import constraints as V
    rows = [(i, v) for i, v in enumerate(["a", "b", "a", None, None, "c", "d", "a", "e", "d"])]
    df = spark.createDataFrame(rows, "_fingerprint bigint, v string")
    rules = [V.Rule("v unique", "unique", "v")]

    def results():
        report = [tuple(r) for r in V.check_constraints(df, rules).collect()]
        return report, sorted(r["key"] for r in V.violating_rows(df, rules, "_fingerprint").collect())
    want = ([("v unique", 8, 5)], [0, 2, 6, 7, 9])
    assert results() == want
    monkeypatch.setattr(V.F, "xxhash64", lambda *c: F.lit(1).cast("long"))           # all values share one
    assert results() == want
    monkeypatch.undo()
    shuffles = []
    monkeypatch.setattr(V, "checkpoint_table", lambda x, name: shuffles.append(x) or x)
    V.check_constraints(df, rules)
    first = shuffles[0]._jdf.queryExecution().executedPlan().toString()
    assert "v#" not in first[first.index("Exchange"):].split("\n")[0]
