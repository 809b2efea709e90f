"""Report and text queries: TXT-01..15.

The driver tables hold no code fences, Python sources or tool reports, so
each query builds its input from whole tables with deterministic expressions
(``conversations`` text, function names, document ids).  The oracle states
the known answer for that construction (K) or recomputes it in SQL (S).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import reports as RP
from shelfwise.plans.oracle_views import with_views
from shelfwise.plans.registry import register
from shelfwise.sources.tables import load, view


def _s(c) -> Column:
    return c.cast("string")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- replies

@register("txt01_extract_code", """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 3 THEN concat('a', chr(9), 'bA', chr(380), 'A ', text)
                                 WHEN 4 THEN concat('q', chr(92), chr(380), 'b', chr(92), 'q ', text) END AS code,
       CASE (conv_id + turn) % 6 WHEN 2 THEN 'no code' WHEN 5 THEN 'bad escape' ELSE 'ok' END AS status FROM conversations""")
def txt01_extract_code(spark, d):
    # Replies: a fenced 'python' block; a bare fence with escaped newlines; no fence; escapes of several
    # kinds; a backslash before other characters; an escape that is cut short.
    c = load(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 6
    fence = lambda *parts: F.concat(F.lit("```"), *parts, F.lit("```"))
    reply = (F.when(k == 0, F.concat(F.lit("Sure.\n```python\n"), F.col("text"), F.lit("\n```\nDone.")))
             .when(k == 1, fence(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))))
             .when(k == 2, F.col("text"))
             .when(k == 3, fence(F.lit("a\\tb\\x41\\u017c\\101 "), F.col("text")))
             .when(k == 4, fence(F.lit("q\\\u017cb\\q "), F.col("text")))
             .otherwise(fence(F.col("text"), F.lit(" \\x1"))))
    return RP.extract_code(c.select("conv_id", "turn", reply.alias("reply")), "reply") \
        .select("conv_id", "turn", "code", "status")


@register("txt02_strip_entry_point", "SELECT conv_id, turn, text AS tests FROM conversations")
def txt02_strip_entry_point(spark, d):
    c = load(spark, d, "conversations")
    k = F.col("turn") % 3
    tests = (F.when(k == 0, F.concat("text", F.lit('\n\nif __name__ == "__main__":\n    unittest.main()\n')))
             .when(k == 1, F.concat("text", F.lit("\nif __name__ == '__main__':\n    main()")))
             .otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))))
    return c.select("conv_id", "turn", RP.strip_entry_point(tests).alias("tests"))


@register("txt03_is_rejected", "SELECT conv_id, turn, turn % 4 IN (0, 1) AS rejected FROM conversations")
def txt03_is_rejected(spark, d):
    c = load(spark, d, "conversations")
    k = F.col("turn") % 4
    reply = (F.when(k == 0, F.lit("rejected")).when(k == 1, F.concat(F.lit("rejected: "), "text"))
             .when(k == 2, F.concat(F.lit(" rejected "), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", RP.is_rejected(reply).alias("rejected"))


_WORDS = "string_split(replace(text, chr(10), ' '), ' ')"


@register("txt04_parse_keywords", f"""
SELECT conv_id, turn, (conv_id + turn) % 9 IN (0, 4) AS valid,
       CASE (conv_id + turn) % 9 WHEN 0 THEN array_to_string(list_sort(list_distinct({_WORDS})), ', ') WHEN 4 THEN '' END AS keywords
FROM conversations""")
def txt04_parse_keywords(spark, d):
    # Replies built from all words of the text: a JSON list, single quotes, numbers, an object, [], a
    # null member, text after the list, an index after it, a second list.
    c = load(spark, d, "conversations")
    words = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")
    listed = F.to_json(words)
    k = (F.col("conv_id") + F.col("turn")) % 9
    reply = (F.when(k == 0, listed)
             .when(k == 1, F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")))
             .when(k == 2, F.to_json(F.transform(words, F.length)))
             .when(k == 3, F.to_json(F.struct(words.alias("k"))))
             .when(k == 4, F.lit("[]"))
             .when(k == 5, F.concat(F.lit("[null, "), F.substring(listed, 2, 1 << 30)))
             .when(k == 6, F.concat(listed, F.lit(" xyz")))
             .when(k == 7, F.concat(listed, F.lit("[0]")))
             .otherwise(F.concat(listed, F.lit(", "), listed)))
    valid, found = RP.parse_keywords(reply)
    return c.select("conv_id", "turn", valid.alias("valid"), F.array_join(found, ", ").alias("keywords"))


# Stand-in texts; what matters is which messages a task has, in which order.
_TASKS = ("doc", "test", "classify", "check")
_PROMPTS = [row for t in _TASKS for row in
            [(t, 1, "system", "rules for writing" if t in ("doc", "test") else "rules for judging"), (t, 2, "user", None),
             (t, 3, "assistant", "received"), (t, 4, "system", "guard"), (t, 5, "user", f"please {t}")]
            if row[1] != 4 or t in ("doc", "test")]


@register("txt05_build_messages", with_views("""
WITH t(task, kind) AS (VALUES ('doc', 'writing'), ('test', 'writing'), ('classify', 'judging'), ('check', 'judging')),
m AS (SELECT function_id, task, 1 AS pos, 'system' AS role, concat('rules for ', kind) AS content FROM functions, t
      UNION ALL SELECT function_id, task, 2, 'user', concat('```', code, '```') FROM functions, t
      UNION ALL SELECT function_id, task, 3, 'assistant', 'received' FROM functions, t
      UNION ALL SELECT function_id, task, 4, 'system', 'guard' FROM functions, t WHERE kind = 'writing'
      UNION ALL SELECT function_id, task, CASE kind WHEN 'writing' THEN 5 ELSE 4 END, 'user', concat('please ', task) FROM functions, t)
SELECT * FROM m""", "functions"))
def txt05_build_messages(spark, d):
    f = view(spark, d, "functions")
    lists = F.inline(F.array(*[F.struct(F.lit(t).alias("task"), RP.build_messages("code", _PROMPTS, t).alias("messages")) for t in _TASKS]))
    m = f.select("function_id", lists).select("function_id", "task", F.posexplode("messages").alias("pos", "m"))
    return m.select("function_id", "task", (F.col("pos") + 1).alias("pos"), "m.role", "m.content")


@register("txt05_conversation_messages", """
WITH c AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN NULL ELSE turn END AS turn, role, text FROM conversations
           UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id + turn) % 7 = 0
           UNION ALL SELECT conv_id, turn, role, substr(text, 1, 20) FROM conversations WHERE (conv_id + turn) % 13 = 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text AS content
FROM c""")
def txt05_conversation_messages(spark, d):
    # Some turns without a number, some sent twice, some sent again in other words.
    c = load(spark, d, "conversations")
    lost = (F.col("conv_id") % 11 == 0) & (F.col("turn") == 2)
    again, other = (c.where((F.col("conv_id") + F.col("turn")) % n == 0) for n in (7, 13))
    return RP.conversation_messages(c.withColumn("turn", F.when(~F.coalesce(lost, F.lit(False)), F.col("turn"))).unionByName(again).unionByName(
        other.withColumn("text", F.substring("text", 1, 20))))


# ---------------------------------------------------------------- tool reports

_LINT_TYPES = ["convention", "refactor", "warning", "error", "fatal", "information"]
_SEC_SEV = ["LOW", "MEDIUM", "HIGH", "UNDEFINED"]
_SEC_CONF = ["LOW", "MEDIUM", "HIGH"]
_TYPE_SEV = ["error", "warning", "information"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def _items(n: Column, make) -> Column:
    """JSON text of ``[make(i) for i in range(n)]``."""
    return F.when(n > 0, F.to_json(F.transform(F.sequence(F.lit(0), n - 1), make))).otherwise(F.lit("[]"))


def _files(spark, d) -> DataFrame:
    """Documents as checked files, with all their lines (a null text is one empty line)."""
    text = F.coalesce("text", F.lit(""))
    return load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), text.alias("text"), F.split(text, "\n").alias("lines"))


def _line(i: Column) -> Column:
    return F.get("lines", i.cast("int"))


def lint_reports(spark, d) -> DataFrame:
    docs = _files(spark, d)
    fid = F.col("file_id")
    make = lambda i: F.struct(
        _pick(_LINT_TYPES, fid + i).alias("type"), F.lit("mod").alias("module"), F.lit("").alias("obj"),
        (i + 1).cast("long").alias("line"), (fid % 5).alias("column"),
        F.when(i % 2 == 0, i + 2).cast("long").alias("endLine"),
        F.when(i % 2 == 0, fid % 5 + 3).alias("endColumn"), F.lit("file.py").alias("path"),
        F.concat(F.lit("rule-"), _s((fid + i) % 7)).alias("symbol"),
        F.concat(F.lit("finding "), _s(fid), F.lit("."), _s(i), F.lit(" "), _line(i)).alias("message"),
        F.concat(F.lit("X"), F.lpad(_s((fid + i) % 100), 4, "0")).alias("message-id"))
    return docs.select("file_id", _items(F.when(fid % 4 == 0, 0).otherwise(F.size("lines")), make).alias("report"))


def security_reports(spark, d) -> DataFrame:
    docs = _files(spark, d)
    fid = F.col("file_id")
    make = lambda i: F.struct(
        F.concat(F.lit("issue "), _s(fid), F.lit("."), _s(i), F.lit(" "), _line(i)).alias("description"),
        F.lit("check").alias("test"), F.concat(F.lit("B"), _s(100 + (fid + i) % 20)).alias("test_id"),
        ((fid + i) % 50).alias("cwe_id"), _pick(_SEC_SEV, fid + i).alias("severity"),
        _pick(_SEC_CONF, fid * (i + 1)).alias("confidence"), F.lit("o").alias("object"),
        F.array((i + 3).cast("long"), (i + 1).cast("long"), (i + 2).cast("long")).alias("line_range"),
        i.cast("long").alias("col"), (i + 4).cast("long").alias("col_end"))
    return docs.select("file_id", _items(F.when(fid % 3 == 0, 0).otherwise(F.size("lines")), make).alias("report"))


def type_reports(spark, d) -> DataFrame:
    docs = _files(spark, d)
    fid = F.col("file_id")
    pos = lambda ln, ch: F.struct(ln.cast("long").alias("line"), ch.cast("long").alias("character"))
    make = lambda i: F.struct(
        _pick(_TYPE_SEV, fid + i).alias("severity"),
        F.concat(F.lit("type issue "), _s(fid), F.lit("."), _s(i), F.lit(" "), _line(i)).alias("message"),
        F.struct(pos(i * 2, i).alias("start"), pos(i * 2 + 1, i + 5).alias("end")).alias("range"))
    diags = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), make).alias("generalDiagnostics")))
    return docs.select("file_id", F.when(fid % 5 == 0, 0).otherwise(1).alias("exit_status"), diags.alias("report"))


def _arr(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_WORD_SQL = "' ', line_text"
_LINES_SQL = "(SELECT doc_id, unnest(ls) AS line_text, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
_LINT_ROWS = f"""lint AS (SELECT doc_id AS file_id, i AS idx, {_arr(_LINT_TYPES)}[(doc_id + i) % 6 + 1] AS type,
       concat('rule-', cast((doc_id + i) % 7 AS varchar)) AS symbol,
       concat('finding ', cast(doc_id AS varchar), '.', cast(i AS varchar), {_WORD_SQL}) AS message,
       concat('X', lpad(cast((doc_id + i) % 100 AS varchar), 4, '0')) AS message_id, '' AS obj,
       i + 1 AS line, doc_id % 5 AS "column",
       CASE WHEN i % 2 = 0 THEN i + 2 END AS endLine, CASE WHEN i % 2 = 0 THEN doc_id % 5 + 3 END AS endColumn
FROM {_LINES_SQL} WHERE doc_id % 4 <> 0)"""
_SEC_ROWS = f"""sec AS (SELECT doc_id AS file_id, i AS idx, concat('issue ', cast(doc_id AS varchar), '.', cast(i AS varchar), {_WORD_SQL}) AS description,
       'check' AS test, concat('B', cast(100 + (doc_id + i) % 20 AS varchar)) AS test_id, (doc_id + i) % 50 AS cwe_id,
       {_arr(_SEC_SEV)}[(doc_id + i) % 4 + 1] AS severity, {_arr(_SEC_CONF)}[(doc_id * (i + 1)) % 3 + 1] AS confidence,
       'o' AS object, i + 1 AS line, i + 3 AS line_end, i AS col, i + 4 AS col_end
FROM {_LINES_SQL} WHERE doc_id % 3 <> 0)"""
_TYPE_ROWS = f"""typ AS (SELECT doc_id AS file_id, i AS idx, {_arr(_TYPE_SEV)}[(doc_id + i) % 3 + 1] AS severity,
       concat('type issue ', cast(doc_id AS varchar), '.', cast(i AS varchar), {_WORD_SQL}) AS message,
       i * 2 + 1 AS line, i * 2 + 2 AS endLine, i AS col, i + 5 AS endCol
FROM {_LINES_SQL} WHERE doc_id % 5 <> 0)"""


@register("txt08_lint_findings", f"""WITH {_LINT_ROWS}
SELECT *, concat('{RP.LINT_DOC_BASE}/', type, '/', symbol, '.html') AS link FROM lint""")
def txt08_lint_findings(spark, d):
    return RP.lint_findings(lint_reports(spark, d))


_TEST_BASE, _CWE_BASE = "https://tests.example/", "https://weaknesses.example/"


@register("txt09_security_findings", f"""WITH {_SEC_ROWS}
SELECT *, concat('{_TEST_BASE}', lower(test_id), '.html') AS test_link,
       CASE WHEN cwe_id = 0 THEN '' ELSE concat('{_CWE_BASE}', cast(cwe_id AS varchar), '.html') END AS cwe_link FROM sec""")
def txt09_security_findings(spark, d):
    return RP.security_findings(security_reports(spark, d), _TEST_BASE, _CWE_BASE)


@register("txt10_type_findings", f"WITH {_TYPE_ROWS} SELECT * FROM typ")
def txt10_type_findings(spark, d):
    return RP.type_findings(type_reports(spark, d))


_LEVEL_SQL = """CASE tool
  WHEN 'lint' THEN CASE WHEN severity IN ('convention', 'information', 'refactor') THEN 'info'
                        WHEN severity IN ('fatal', 'error') THEN 'error' WHEN severity = 'warning' THEN 'warning' ELSE 'error' END
  WHEN 'security' THEN CASE severity WHEN 'LOW' THEN 'info' WHEN 'MEDIUM' THEN 'warning' ELSE 'error' END
  ELSE CASE severity WHEN 'information' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'error' END END"""
_ALL_FINDINGS = f"""{_LINT_ROWS}, {_SEC_ROWS}, {_TYPE_ROWS},
allf AS (SELECT 'lint' AS tool, file_id, idx, type AS severity, line, message AS text FROM lint
         UNION ALL SELECT 'security', file_id, idx, severity, line, description FROM sec
         UNION ALL SELECT 'type', file_id, idx, severity, line, message FROM typ)"""


def _all_findings(spark, d):
    lint = RP.lint_findings(lint_reports(spark, d))
    sec = RP.security_findings(security_reports(spark, d), _TEST_BASE, _CWE_BASE)
    typ = RP.type_findings(type_reports(spark, d))
    return lint, sec, typ


@register("txt11_severity_levels", f"""WITH {_ALL_FINDINGS}
SELECT tool, file_id, idx, severity, {_LEVEL_SQL} AS level FROM allf""")
def txt11_severity_levels(spark, d):
    lint, sec, typ = _all_findings(spark, d)
    u = (lint.select(F.lit("lint").alias("tool"), "file_id", "idx", F.col("type").alias("severity"))
         .unionByName(sec.select(F.lit("security").alias("tool"), "file_id", "idx", "severity"))
         .unionByName(typ.select(F.lit("type").alias("tool"), "file_id", "idx", "severity")))
    return u.withColumn("level", RP.severity_level(F.col("tool"), F.col("severity")))


@register("txt12_marker_range", f"""WITH {_LINT_ROWS}
SELECT file_id, idx, line - 1 AS start_row, "column" AS start_column,
       coalesce(endLine, line) - 1 AS end_row, coalesce(endColumn, 2147483647) AS end_column FROM lint""")
def txt12_marker_range(spark, d):
    # Cells as the results table renders them: numbers as text, missing values as 'None'.
    lint = RP.lint_findings(lint_reports(spark, d))
    cell = lambda c: F.coalesce(_s(F.col(c)), F.lit("None"))
    cells = lint.select("file_id", "idx", cell("line").alias("c_sl"), cell("column").alias("c_sc"),
                        cell("endLine").alias("c_el"), cell("endColumn").alias("c_ec"))
    return RP.marker_range(cells, "c_sl", "c_sc", "c_el", "c_ec") \
        .select("file_id", "idx", "start_row", "start_column", "end_row", "end_column")


@register("txt13_annotations", f"""WITH {_ALL_FINDINGS}
SELECT file_id, idx, tool, line - 1 AS row, text, {_LEVEL_SQL} AS type, 0 AS column FROM allf""")
def txt13_annotations(spark, d):
    return RP.annotations(*_all_findings(spark, d))


@register("txt13_finding_counts", f"""WITH {_ALL_FINDINGS}
SELECT doc_id AS file_id,
       (SELECT count(*) FROM allf a WHERE a.file_id = doc_id AND tool = 'lint') AS lint_findings,
       (SELECT count(*) FROM allf a WHERE a.file_id = doc_id AND tool = 'security') AS security_findings,
       (SELECT count(*) FROM allf a WHERE a.file_id = doc_id AND tool = 'type') AS type_findings
FROM documents""")
def txt13_finding_counts(spark, d):
    files = load(spark, d, "documents").select(F.col("doc_id").alias("file_id"))
    return RP.finding_counts(RP.annotations(*_all_findings(spark, d)), files)


def test_reports(spark, d) -> DataFrame:
    """Reports of nine kinds by file: three results, a result without two of its lists, and five
    forms of a failed call (no payload, typed, timed out, without a value, untyped), with a message for
    every line of the document, or its whole text."""
    docs = _files(spark, d)
    fid = F.col("file_id")
    total = fid % 7 + 3
    none = F.array().cast("array<string>")
    said = lambda kind: F.transform("lines", lambda x: F.concat(F.lit(f"{kind} "), _s(fid), F.lit(" "), x))
    call = lambda error, **more: F.to_json(
        F.struct(F.lit(error).alias("error"), *[v.alias(k) for k, v in more.items()]), {"ignoreNullFields": "false"})
    odd = F.floor(fid / 9) % 2 == 1        # of a kind, every second has a null in its payload
    late = F.lit("Task timed out after 3.00 seconds")

    def result(failures, errors, skipped, successful):
        return F.to_json(F.struct(total.alias("total"), failures.alias("failures"), errors.alias("errors"), skipped.alias("skipped"),
                                  F.lit(successful).alias("successful")))

    k = fid % 9
    rep = (F.when(k == 0, result(none, none, none, True)).when(k == 1, result(said("f"), said("e"), F.array(F.lit("s")), False))
           .when(k == 2, result(none, none, none, False))
           .when(k == 3, call("Unhandled", payload=F.struct(F.lit(None).cast("string").alias("x"))))
           .when(k == 4, call("Unhandled", payload=F.struct(
               F.when(~odd, F.lit("MemoryError")).alias("errorType"), F.col("text").alias("errorMessage"))))
           .when(k == 5, call("Unhandled", errorMessage=late, payload=F.struct(late.alias("errorMessage"))))
           .when(k == 6, F.concat(F.lit('{"error": null, "payload": '), F.to_json(F.struct(F.col("text").alias("errorMessage"))), F.lit("}")))
           .when(k == 7, call("Unhandled", payload=F.struct(F.when(~odd, F.col("text")).alias("errorMessage"))))
           .otherwise(F.to_json(F.struct(total.alias("total"), said("f").alias("failures"), F.lit(False).alias("successful")))))
    return docs.select("file_id", rep.alias("report"))


_TEXT, _ODD = "coalesce(text, '')", "(doc_id // 9) % 2 = 1"
_N_LINES = f"len(string_split({_TEXT}, chr(10)))"
_SAID = "array_to_string(list_transform(string_split(" + _TEXT + ", chr(10)), lambda x: concat('{kind} ', cast(doc_id AS varchar), ' ', x)), chr(10))"


@register("txt14_test_results_page", f"""
SELECT doc_id AS file_id, doc_id % 9 = 0 AS success,
       CASE doc_id % 9 WHEN 0 THEN doc_id % 7 + 3 WHEN 1 THEN doc_id % 7 + 3 - 3 * {_N_LINES} - 1 WHEN 2 THEN doc_id % 7 + 3 - 1
                       ELSE 0 END AS ok,
       CAST(CASE doc_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 3 * {_N_LINES} + 1 ELSE 1 END AS BIGINT) AS fail,
       CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat({_SAID.format(kind='f')}, chr(10), {_SAID.format(kind='e')})
                       ELSE 'Failed to run unit tests' END AS messages
FROM documents""")
def txt14_test_results_page(spark, d):
    return RP.test_results(test_reports(spark, d), "page")


@register("txt14_test_results_handle", f"""
SELECT doc_id AS file_id, doc_id % 9 = 0 AS success,
       CASE WHEN doc_id % 9 IN (0, 1, 2, 8) THEN doc_id % 7 + 3 ELSE 0 END AS executed,
       CASE doc_id % 9 WHEN 0 THEN doc_id % 7 + 3 WHEN 1 THEN doc_id % 7 + 3 - 2 * {_N_LINES} - 1 WHEN 2 THEN doc_id % 7 + 3
                       WHEN 8 THEN doc_id % 7 + 3 - {_N_LINES} END AS ok,
       CASE doc_id % 9 WHEN 1 THEN {_SAID.format(kind='e')} WHEN 3 THEN 'Unhandled'
                       WHEN 4 THEN concat('Unhandled: ', CASE WHEN {_ODD} THEN 'None' ELSE 'MemoryError' END, ': ', {_TEXT})
                       WHEN 5 THEN 'Unhandled: Execution took too long, task timed out.' WHEN 6 THEN concat('None: ', {_TEXT})
                       WHEN 7 THEN concat('Unhandled: ', CASE WHEN {_ODD} THEN 'None' ELSE {_TEXT} END) ELSE '' END AS errors,
       CASE WHEN doc_id % 9 IN (1, 8) THEN {_SAID.format(kind='f')} WHEN doc_id % 9 IN (0, 2) THEN '' END AS failures,
       CASE WHEN doc_id % 9 = 1 THEN 's' WHEN doc_id % 9 IN (0, 2, 8) THEN '' END AS skipped
FROM documents""")
def txt14_test_results_handle(spark, d):
    out = RP.test_results(test_reports(spark, d), "handle")
    return out.withColumns({c: F.array_join(c, "\n") for c in ("errors", "failures", "skipped")})


@register("txt15_nl_to_br", "SELECT conv_id, turn, replace(text, chr(10), '<br>') AS html FROM conversations")
def txt15_nl_to_br(spark, d):
    from shelfwise.functions.text import nl_to_br
    return load(spark, d, "conversations").select("conv_id", "turn", nl_to_br("text").alias("html"))
