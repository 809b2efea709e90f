"""Search queries: PRJ-01..04, PRJ-14, SET-01, SET-02."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.text import normalise_keywords, split_keywords
from shelfwise.operators import search as S
from shelfwise.plans.oracle_views import with_views
from shelfwise.plans.registry import register
from shelfwise.sources.tables import load, view

# Line boundaries of Python's str.splitlines, in RE2 syntax (oracle side).
_LINES_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _lines_ctes(term: str) -> str:
    """CTEs ending in ``code_hits``: the code lines that contain ``term``."""
    t = term.replace("'", "''")
    return f"""
sp AS (SELECT function_id, name, regexp_split_to_array(code, '{_LINES_RE2}') AS parts
       FROM functions WHERE contains(lower(code), lower('{t}'))),
tl AS (SELECT function_id, name,
              CASE WHEN len(parts) > 0 AND parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines
       FROM sp),
ex AS (SELECT function_id, name, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS line_no FROM tl),
code_hits AS (SELECT 'source code' AS result_type, function_id, name AS function_name, line AS context,
       '{t}' AS match, CAST(line_no AS INTEGER) AS line_no
FROM ex WHERE contains(line, '{t}'))"""


def _library_ctes(term: str) -> str:
    """CTEs ending in ``lib``: the SET-01 union for ``term``."""
    return _lines_ctes(term) + f""",
lib AS (
SELECT *, 1 AS rank, CAST(NULL AS INTEGER) AS line_no FROM ({_field_sql("keywords", term)})
UNION ALL SELECT *, 2 AS rank, CAST(NULL AS INTEGER) AS line_no FROM ({_field_sql("usecase", term)})
UNION ALL SELECT result_type, function_id, function_name, context, match, 3 AS rank, line_no FROM code_hits)"""


def _field_sql(field: str, term: str) -> str:
    t = term.replace("'", "''")
    return (f"SELECT '{field}' AS result_type, function_id, name AS function_name, {field} AS context, "
            f"'{t}' AS match FROM functions WHERE contains(lower({field}), lower('{t}'))")


@register("prj01_search_keywords", with_views(_field_sql("keywords", "Promo"), "functions"))
def prj01_search_keywords(spark, d):
    return S.search_field(view(spark, d, "functions"), "keywords", "Promo")


@register("prj01_search_usecase_wildcards", with_views(_field_sql("usecase", "0% lo"), "functions"))
def prj01_search_usecase_wildcards(spark, d):
    # '%' must be literal: only usecases '...<even size>0% load' match.
    return S.search_field(view(spark, d, "functions"), "usecase", "0% lo")


@register("prj02_search_lines", with_views("WITH " + _lines_ctes("the") + " SELECT * FROM code_hits",
                                            "functions"))
def prj02_search_lines(spark, d):
    return S.search_lines(view(spark, d, "functions"), "the")


@register("set01_search_library", with_views("WITH " + _library_ctes("en") + " SELECT * FROM lib",
                                              "functions"))
def set01_search_library(spark, d):
    return S.search_library(view(spark, d, "functions"), "en")


@register("prj04_highlight", with_views("WITH " + _library_ctes("en") + """
SELECT result_type, function_id, function_name,
       regexp_replace(context, '(?i)en', '<mark>\\0</mark>', 'g') AS context, match, rank, line_no
FROM lib""", "functions"))
def prj04_highlight(spark, d):
    return S.highlight_results(S.search_library(view(spark, d, "functions"), "en"), "en")


_MANY_SQL = """
SELECT t.term, f.function_id, x.result_type
FROM terms t, (SELECT function_id, 'keywords' AS result_type, keywords AS text FROM functions
               UNION ALL SELECT function_id, 'usecase', usecase FROM functions
               UNION ALL SELECT function_id, 'code', code FROM functions) x
JOIN functions f ON f.function_id = x.function_id
WHERE contains(lower(x.text), lower(t.term))"""


@register("prj03_search_many", with_views(
    "WITH terms AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)" + _MANY_SQL,
    "functions"))
def prj03_search_many(spark, d):
    # Terms: every word used in part names (grows with the part table).
    terms = load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return S.search_many(view(spark, d, "functions"), terms)


@register("prj03_search_many_short", with_views(
    "WITH terms AS (SELECT DISTINCT lang AS term FROM documents)" + _MANY_SQL, "functions"))
def prj03_search_many_short(spark, d):
    # A few short terms (language codes), which nearly every text contains.
    terms = load(spark, d, "documents").select(F.col("lang").alias("term"))
    return S.search_many(view(spark, d, "functions"), terms)


@register("prj03_search_many_words", with_views(
    "WITH terms AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS term FROM benchmark)" + _MANY_SQL,
    "functions"))
def prj03_search_many_words(spark, d):
    # Terms: every word of the benchmark passages (thousands of terms).
    terms = load(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("term"))
    return S.search_many(view(spark, d, "functions"), terms)


@register("prj14_normalise_keywords", with_views("""
SELECT function_id,
       array_to_string(list_sort(list_distinct(list_transform(string_split(keywords, ','), lambda x: trim(x)))), ', ')
         AS keywords
FROM functions""", "functions"))
def prj14_normalise_keywords(spark, d):
    return view(spark, d, "functions").select("function_id", normalise_keywords("keywords").alias("keywords"))


@register("prj14_split_keywords", with_views("""
SELECT function_id, unnest(generate_series(1, len(string_split(keywords, ',')))) AS pos,
       unnest(list_transform(string_split(keywords, ','), lambda x: trim(x))) AS keyword
FROM functions""", "functions"))
def prj14_split_keywords(spark, d):
    f = view(spark, d, "functions")
    return f.select("function_id", F.posexplode(split_keywords("keywords")).alias("pos", "keyword")) \
        .withColumn("pos", (F.col("pos") + 1).cast("bigint"))


@register("set02_library_keywords", with_views("""
SELECT keyword, count(*) AS functions FROM (
  SELECT DISTINCT function_id, unnest(list_transform(string_split(keywords, ','), lambda x: trim(x))) AS keyword
  FROM functions) GROUP BY keyword""", "functions"))
def set02_library_keywords(spark, d):
    return S.library_keywords(view(spark, d, "functions"))
