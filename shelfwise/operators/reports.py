"""Reply, code and tool-report jobs (TXT-01..15).

Each is a job over a table of texts or JSON reports.  Parsing is
``from_json`` with an explicit schema, flattening is ``explode``/``inline``,
all JVM-side; only escape decoding calls the pandas UDF in
``functions.pyhelpers``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.pyhelpers import decode_escapes_udf
from shelfwise.functions.text import py_strip

# ---------------------------------------------------------------- replies

# What counts as a fenced block and as an entry point.
FENCE_RX = r"(?s)```(.+?)```"
ENTRY_POINT_RX = r"""(?s)if __name__ == ("|')__main__("|'):.+$"""
STATUS_OK, STATUS_NO_CODE, STATUS_BAD_ESCAPE = "ok", "no code", "bad escape"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_code(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """TXT-01: first fenced block, stripped, leading 'python' removed, stripped,
    backslash escapes decoded.  Adds ``out`` and ``status``."""
    c = F.col(col)
    found = c.rlike(FENCE_RX)
    block = py_strip(F.regexp_extract(c, FENCE_RX, 1))
    block = py_strip(F.when(block.startswith("python"), F.substring(block, 7, 1 << 30)).otherwise(block))
    block = F.when(found, block)
    has_bs = F.coalesce(F.contains(block, F.lit("\\")), F.lit(False))
    # Only rows holding a backslash send their text to Python; the rest send NULL.
    decoded = decode_escapes_udf(F.when(has_bs, block))
    code = F.when(has_bs, decoded).otherwise(block)
    status = (F.when(~F.coalesce(found, F.lit(False)), F.lit(STATUS_NO_CODE))
              .when(has_bs & decoded.isNull(), F.lit(STATUS_BAD_ESCAPE)).otherwise(F.lit(STATUS_OK)))
    return df.withColumn(out, code).withColumn("status", status)


def strip_entry_point(c) -> Column:
    """TXT-02: cut a trailing ``if __name__ == "__main__": ...`` block, then strip."""
    return py_strip(F.regexp_replace(_c(c), ENTRY_POINT_RX, ""))


def is_rejected(c) -> Column:
    """TXT-03: the reply starts with 'rejected' (case-sensitive, before any strip)."""
    return _c(c).startswith("rejected")


def parse_keywords(c) -> tuple[Column, Column]:
    """TXT-04: a JSON list of strings -> (valid, sorted distinct array).

    Spark's JSON readers stop after the first value and take single quotes and numbers for strings.
    So the text has to parse as the only member of a list and as the member of an object, which
    rules out anything after it; the variant's type tells that all members are strings.
    """
    c = _c(c)
    inside = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    alone = inside.isNotNull() & member.isNotNull() & F.try_variant_get(inside, "$[1]", "variant").isNull()
    kind = F.schema_of_variant(F.try_parse_json(c))
    arr = F.from_json(c, T.ArrayType(T.StringType()), {"allowSingleQuotes": "false"})
    no_null = F.coalesce(F.forall(arr, lambda x: x.isNotNull()), F.lit(False))
    valid = F.coalesce(alone & ((kind == "ARRAY<STRING>") | ((kind == "ARRAY<VOID>") & (F.size(arr) == 0))) & no_null, F.lit(False))
    return valid, F.when(valid, F.array_sort(F.array_distinct(arr)))


def build_messages(c, prompts: Sequence[tuple[str, int, str, str | None]], task: str) -> Column:
    """TXT-05: the message list (array of struct(role, content)) of one task for a source text.

    ``prompts`` is a small table of (task, position, role, content) rows, given by the caller; a row
    without content is the place of the source, which goes between triple backticks.
    """
    fenced = F.concat(F.lit("```"), _c(c), F.lit("```"))
    rows = sorted((p, r, t) for k, p, r, t in prompts if k == task)
    return F.array(*[F.struct(F.lit(r).alias("role"), (fenced if t is None else F.lit(t)).alias("content")) for _, r, t in rows])


def conversation_messages(conv: DataFrame) -> DataFrame:
    """TXT-05: messages of each conversation in turn order, with 1-based ``pos``.

    Positions come from numbering whole rows in ranges of (conversation, turn, role, start of the text), so
    one very long conversation is spread over many tasks, and every row has a place of its own: null
    turns come first, rows with one turn follow each other by role and text, and repeated rows stay
    as often as they are.  Rows without a conversation id are one conversation.
    """
    from shelfwise.sources.writers import sequential_ids

    rows = conv.select("conv_id", "turn", "role", "text", F.substring("text", 1, 16).alias("_start"))
    placed = sequential_ids(rows, ["turn", "role", "text"], "pos", start=1, group=["conv_id"], ranges=["turn", "role", "_start"])
    return placed.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "role", F.col("text").alias("content"))


# ---------------------------------------------------------------- tool reports

# Fixed value: the documentation base of the lint messages.
LINT_DOC_BASE = "https://pylint.pycqa.org/en/latest/user_guide/messages"

LINT_ITEM = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("module", T.StringType()),
    T.StructField("obj", T.StringType()), T.StructField("line", T.LongType()),
    T.StructField("column", T.LongType()), T.StructField("endLine", T.LongType()),
    T.StructField("endColumn", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("symbol", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("message-id", T.StringType()),
])
SECURITY_ITEM = T.StructType([
    T.StructField("description", T.StringType()), T.StructField("test", T.StringType()),
    T.StructField("test_id", T.StringType()), T.StructField("cwe_id", T.LongType()),
    T.StructField("severity", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("object", T.StringType()), T.StructField("line_range", T.ArrayType(T.LongType())),
    T.StructField("col", T.LongType()), T.StructField("col_end", T.LongType()),
])
_POS = T.StructType([T.StructField("line", T.LongType()), T.StructField("character", T.LongType())])
TYPE_REPORT = T.StructType([T.StructField("generalDiagnostics", T.ArrayType(T.StructType([
    T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("range", T.StructType([T.StructField("start", _POS), T.StructField("end", _POS)])),
])))])


def lint_findings(reports: DataFrame, key: str = "file_id", col: str = "report") -> DataFrame:
    """TXT-08: one row per lint finding plus its documentation link."""
    items = reports.select(key, F.posexplode(F.from_json(col, T.ArrayType(LINT_ITEM))).alias("idx", "f"))
    return items.select(key, F.col("idx").cast("bigint").alias("idx"), "f.type", "f.symbol", "f.message", F.col("f.`message-id`").alias("message_id"),
                        "f.obj", "f.line", "f.column", "f.endLine", "f.endColumn",
                        F.concat_ws("/", F.lit(LINT_DOC_BASE), F.col("f.type"),
                                    F.concat(F.col("f.symbol"), F.lit(".html"))).alias("link"))


def security_findings(reports: DataFrame, test_base: str, cwe_base: str, key: str = "file_id", col: str = "report") -> DataFrame:
    """TXT-09: one row per security finding; line/line_end = min/max of the line range; the links
    are the given bases followed by the test id and by the number of the weakness (none: empty)."""
    items = reports.select(key, F.posexplode(F.from_json(col, T.ArrayType(SECURITY_ITEM))).alias("idx", "f"))
    return items.select(key, F.col("idx").cast("bigint").alias("idx"), "f.description", "f.test", "f.test_id",
                        F.concat(F.lit(test_base), F.lower("f.test_id"), F.lit(".html")).alias("test_link"), "f.cwe_id",
                        F.when(F.coalesce(F.col("f.cwe_id"), F.lit(0)) == 0, F.lit("")).otherwise(
                            F.concat(F.lit(cwe_base), F.col("f.cwe_id").cast("string"), F.lit(".html"))).alias("cwe_link"),
                        "f.severity", "f.confidence", "f.object",
                        F.array_min("f.line_range").alias("line"), F.array_max("f.line_range").alias("line_end"),
                        "f.col", "f.col_end")


def type_findings(reports: DataFrame, key: str = "file_id", col: str = "report",
                  status: str = "exit_status") -> DataFrame:
    """TXT-10: type-check diagnostics; lines +1, columns as they are; exit status 0 -> none."""
    rep = reports.filter(F.col(status) != 0)
    items = rep.select(key, F.posexplode(F.from_json(col, TYPE_REPORT).getField("generalDiagnostics"))
                       .alias("idx", "f"))
    return items.select(key, F.col("idx").cast("bigint").alias("idx"), "f.severity", "f.message",
                        (F.col("f.range.start.line") + 1).alias("line"),
                        (F.col("f.range.end.line") + 1).alias("endLine"),
                        F.col("f.range.start.character").alias("col"),
                        F.col("f.range.end.character").alias("endCol"))


# Fixed values below: the tools' severity names and the level each one shows as.
def severity_level(tool, sev) -> Column:
    """TXT-11: each tool's severity -> info / warning / error (unknown -> error)."""
    t, s = _c(tool), _c(sev)
    lint = (F.when(s.isin("convention", "information", "refactor"), "info")
            .when(s.isin("fatal", "error"), "error").when(s == "warning", "warning").otherwise("error"))
    sec = F.when(s == "LOW", "info").when(s == "MEDIUM", "warning").otherwise("error")
    typ = F.when(s == "information", "info").when(s == "warning", "warning").otherwise("error")
    return F.when(t == "lint", lint).when(t == "security", sec).otherwise(typ)


# Editor 'infinity' for an open end column.
INFINITY_COL = 2147483647


def _convert(cell: Column) -> Column:
    return F.when(cell == "None", F.lit(None).cast("long")).otherwise(cell.try_cast("long") - 1)


def marker_range(df: DataFrame, start_line: str, start_col: str, end_line: str, end_col: str) -> DataFrame:
    """TXT-12: editor range from table-cell texts: 'None' -> NULL, else n - 1; end line
    defaults to start line, end column to infinity, start column to 1; columns then +1."""
    sl = _convert(F.col(start_line))
    sc = F.coalesce(_convert(F.col(start_col)), F.lit(1))
    el = F.coalesce(_convert(F.col(end_line)), sl)
    ec = _convert(F.col(end_col))
    return df.select("*", sl.alias("start_row"), (sc + 1).alias("start_column"), el.alias("end_row"),
                     F.when(ec.isNull(), F.lit(INFINITY_COL)).otherwise(ec + 1).alias("end_column"))


def annotations(lint: DataFrame, sec: DataFrame, typ: DataFrame, key: str = "file_id") -> DataFrame:
    """TXT-13: editor annotations of all three tools: row = line - 1, column 0, text, type."""
    parts = [
        lint.select(key, "idx", F.lit("lint").alias("tool"), (F.col("line") - 1).alias("row"),
                    F.col("message").alias("text"), severity_level(F.lit("lint"), F.col("type")).alias("type")),
        sec.select(key, "idx", F.lit("security").alias("tool"), (F.col("line") - 1).alias("row"),
                   F.col("description").alias("text"),
                   severity_level(F.lit("security"), F.col("severity")).alias("type")),
        typ.select(key, "idx", F.lit("type").alias("tool"), (F.col("line") - 1).alias("row"),
                   F.col("message").alias("text"), severity_level(F.lit("type"), F.col("severity")).alias("type")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("column", F.lit(0))


def finding_counts(ann: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """TXT-13: per file, findings per tool; files with clean reports get 0."""
    counts = ann.groupBy(key).pivot("tool", ["lint", "security", "type"]).agg(F.count(F.lit(1)))
    return files.select(key).join(counts, key, "left").select(
        key, *[F.coalesce(F.col(t), F.lit(0)).alias(f"{t}_findings") for t in ("lint", "security", "type")])


TEST_REPORT = T.StructType([
    T.StructField("total", T.LongType()), T.StructField("successful", T.BooleanType()),
    T.StructField("failures", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("skipped", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
    T.StructField("errorMessage", T.StringType()),
    T.StructField("payload", T.StructType([T.StructField("errorType", T.StringType()),
                                           T.StructField("errorMessage", T.StringType())])),
])
# The reference's test-run messages.
RUN_FAILED = "Failed to run unit tests"
TIMED_OUT = "Task timed out after"
TIMED_OUT_TEXT = ": Execution took too long, task timed out."


def test_results(reports: DataFrame, variant: str = "page", key: str = "file_id",
                 col: str = "report") -> DataFrame:
    """TXT-14: test-run results.

    ``page`` -> (success, ok, fail, messages): failures then errors in one list; errors are counted
    twice in ``fail`` (as the page does); an unsuccessful run with no messages shows one generic
    failure; a report without one of its keys (a crash report has none) shows ok 0, fail 1.
    ``handle`` -> (success, executed, ok, errors, failures, skipped): ok = total - errors - failures
    - skipped; a report with an ``error`` key, whatever its value, becomes one error message
    ('<error>: <type>: <message>' or the time-out form) without counts and lists; members of the payload
    count when their key is there, and a null reads ``None``.
    """
    r = F.from_json(F.col(col), TEST_REPORT)
    base = reports.select(key, col, r.alias("r"), F.coalesce(F.json_object_keys(col), F.array().cast("array<string>")).alias("keys"))

    def has(name: str) -> Column:
        return F.array_contains("keys", name)

    lists = [F.coalesce(F.col(f"r.{n}"), F.array().cast("array<string>")) for n in ("failures", "errors", "skipped")]
    fl, er, sk = lists
    if variant == "page":
        crashed = ~(has("total") & has("failures") & has("errors") & has("skipped") & has("successful"))
        merged = F.concat(fl, er)
        msgs = F.when(crashed, F.array(F.lit(RUN_FAILED))) \
            .when((F.size(merged) == 0) & ~F.coalesce(F.col("r.successful"), F.lit(False)), F.array(F.lit(RUN_FAILED))) \
            .otherwise(merged)
        fail = F.when(crashed, F.lit(1)).otherwise(F.size(er) + F.size(msgs) + F.size(sk))
        ok = F.when(crashed, F.lit(0)).otherwise(F.col("r.total") - fail)
        return base.select(key, F.coalesce(~crashed & F.col("r.successful"), F.lit(False)).alias("success"),
                           ok.cast("bigint").alias("ok"), fail.cast("bigint").alias("fail"),
                           F.array_join(msgs, "\n").alias("messages"))
    is_err = has("error")
    err = F.coalesce(F.col("r.error"), F.lit("None"))          # as a missing value reads in a message
    timed_out = F.coalesce(F.contains(F.col("r.errorMessage"), F.lit(TIMED_OUT)), F.lit(False))
    inner = F.json_object_keys(F.get_json_object(col, "$.payload"))

    def said(name: str) -> Column:
        """A member of the payload as it reads in a message; null (left out) where there is none."""
        return F.when(F.array_contains(inner, name), F.coalesce(F.col(f"r.payload.{name}"), F.lit("None")))

    base = base.select("*", said("errorType").alias("error_type"), said("errorMessage").alias("error_message"))
    err_msg = F.when(timed_out, F.concat(err, F.lit(TIMED_OUT_TEXT))).otherwise(F.concat_ws(": ", err, "error_type", "error_message"))
    ok = F.col("r.total") - F.size(er) - F.size(fl) - F.size(sk)

    def unless_error(value: Column) -> Column:
        return F.when(~is_err, value)

    return base.select(key, F.when(is_err, F.lit(False)).otherwise(F.col("r.successful")).alias("success"),
                       F.when(is_err, F.lit(0)).otherwise(F.col("r.total")).cast("bigint").alias("executed"),
                       unless_error(ok).cast("bigint").alias("ok"),
                       F.when(is_err, F.array(err_msg)).otherwise(er).alias("errors"),
                       unless_error(fl).alias("failures"), unless_error(sk).alias("skipped"))
