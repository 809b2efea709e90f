"""Library search (PRJ-01..04, SET-01, SET-02).

PRJ-01 is a case-insensitive *literal* substring filter (the reference escapes
``%`` and ``_``; ``contains(lower, lower)`` has no wildcards at all).  PRJ-02
then splits the matching code into lines and keeps lines that contain the term
case-sensitively, one output row per line.  PRJ-03 searches many terms at
once, in the scan of the texts: terms come in blocks of bounded size, and no text
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.byte_windows import TermSet, scan, term_keys
from shelfwise.functions.text import (contains_ci, drop_trailing_empty, highlight, split_keywords,
                                      split_line_parts)
from shelfwise.session import checkpoint_table

RESULT_CODE = "source code"
FIELDS = ("keywords", "usecase", "code")


def search_field(f: DataFrame, field: str, term: str) -> DataFrame:
    """PRJ-01: rows whose ``field`` contains ``term`` (case-insensitive literal)."""
    return f.filter(contains_ci(field, term)).select(
        F.lit(field).alias("result_type"), "function_id",
        F.col("name").alias("function_name"), F.col(field).alias("context"),
        F.lit(term).alias("match"))


def search_lines(f: DataFrame, term: str) -> DataFrame:
    """PRJ-02: one row per code line containing ``term`` (case-sensitive), for code
    rows that contain it case-insensitively.  ``line_no`` is 1-based."""
    parts = f.filter(contains_ci("code", term)).select(
        "function_id", "name", split_line_parts(F.col("code")).alias("_parts"))
    hits = parts.select("function_id", "name",
                        F.posexplode(drop_trailing_empty("_parts")).alias("pos", "line"))
    return hits.filter(F.contains(F.col("line"), F.lit(term))).select(
        F.lit(RESULT_CODE).alias("result_type"), "function_id",
        F.col("name").alias("function_name"), F.col("line").alias("context"),
        F.lit(term).alias("match"), (F.col("pos") + 1).alias("line_no"))


def search_library(f: DataFrame, term: str) -> DataFrame:
    """SET-01: keywords hits, then usecase hits, then code-line hits (bag union), in one pass over the rows.

    ``rank`` (1, 2, 3) and ``line_no`` (NULL for whole fields) keep the
    reference's order available: order by rank, function_id, line_no.
    """
    kind = "array<struct<result_type:string,context:string,rank:int,line_no:int>>"

    def hit(result_type: str, context: Column, rank: int, line_no: Column) -> Column:
        return F.struct(F.lit(result_type).alias("result_type"), context.alias("context"), F.lit(rank).alias("rank"),
                        line_no.cast("int").alias("line_no"))

    def whole(field: str, rank: int) -> Column:
        found = F.array(hit(field, F.col(field), rank, F.lit(None)))
        return F.when(contains_ci(field, term), found.cast(kind)).otherwise(F.array().cast(kind))

    lines = F.transform(drop_trailing_empty("_parts"), lambda line, i: hit(RESULT_CODE, line, 3, i + 1))
    lines = F.filter(lines, lambda x: F.contains(x["context"], F.lit(term)))
    hits = f.withColumn("_parts", F.when(contains_ci("code", term), split_line_parts(F.col("code"))))
    hits = hits.select("function_id", F.col("name").alias("function_name"), F.inline(F.concat(
        whole("keywords", 1), whole("usecase", 2), F.coalesce(lines.cast(kind), F.array().cast(kind)))))
    return hits.select("result_type", "function_id", "function_name", "context", F.lit(term).alias("match"), "rank", "line_no")


def highlight_results(results: DataFrame, term: str, col: str = "context") -> DataFrame:
    """PRJ-04: mark every case-insensitive literal occurrence of ``term``."""
    return results.withColumn(col, highlight(F.col(col), term))


def library_keywords(f: DataFrame) -> DataFrame:
    """SET-02 table form: each distinct keyword with the number of functions carrying it."""
    kw = f.select("function_id", F.explode(F.array_distinct(split_keywords(F.col("keywords"))))
                  .alias("keyword"))
    return kw.groupBy("keyword").agg(F.count(F.lit(1)).alias("functions"))


# ---------------------------------------------------------------- PRJ-03

# Terms that one scan of the texts looks for: what the driver gathers and a task holds is 16 bytes each.
TERMS_A_SCAN = 1 << 18


def _long_form(f: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(function_id, fidx, ltext) with one row per (function, field) that has a text."""
    return f.select("function_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("fidx"), F.lower(fld).alias("ltext")) for i, fld in enumerate(fields)]))).where("ltext is not null")


def search_many(f: DataFrame, terms: DataFrame, fields: Sequence[str] = FIELDS, terms_a_scan: int = TERMS_A_SCAN) -> DataFrame:
    """PRJ-03: every (term, function, field) where the field contains the term
    (case-insensitive literal).  ``terms`` has a ``term`` column.

    The terms' keys are tested at every place of every text in the stage that scans the texts (see
    ``byte_windows``); what leaves it is a row per text and term found, which a join by key turns into
    terms.  More than ``terms_a_scan`` terms are dealt by hash to several scans.  Terms of up to eight
    bytes are compared as they are, longer ones by 128 bits of hashes.  Null terms and texts match
    nothing, the empty term every text.
    """
    names = F.array(*[F.lit(fld) for fld in fields])
    t = _keyed_terms(terms)
    docs = _long_form(f, fields)
    n, empty = t.agg(F.count(F.lit(1)), F.count_if(F.col("size") == 0)).first()
    scans = -(-n // terms_a_scan)
    parts = [_found(docs, t.where((F.col("size") > 0) & (F.pmod(F.xxhash64("one", "two"), F.lit(scans)) == b))) for b in range(scans)]
    if empty:
        parts.append(docs.select(F.lit("").alias("term"), "function_id", "fidx"))
    if not parts:
        parts = [docs.limit(0).select(F.lit("").alias("term"), "function_id", "fidx")]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("term", "function_id", F.element_at(names, F.col("fidx") + 1).alias("result_type"))


def _keyed_terms(terms: DataFrame) -> DataFrame:
    """(term, size, one, two, lead) of the distinct terms, written; keys of the lower-case form."""
    t = terms.select("term").where("term is not null").distinct().withColumn("lt", F.lower("term"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, *hashes = term_keys(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes)],
                                             names=["term", "size", "one", "two", "lead"])

    return checkpoint_table(t.mapInArrow(keys, "term string, size long, one long, two long, lead long"), "terms")


def _found(docs: DataFrame, t: DataFrame) -> DataFrame:
    """(term, function_id, fidx) of the texts that contain a term of ``t``, a bounded block of terms."""
    held = t.select("size", "one", "lead").distinct().toPandas()
    block = TermSet(held["size"].to_numpy(np.int64), held["one"].to_numpy(np.int64).view(np.uint64), held["lead"].to_numpy(np.int64).view(np.uint64))
    kind = docs.schema["function_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan(batches, "ltext", ["function_id", "fidx"], block)

    hits = docs.mapInArrow(search, f"function_id {kind}, fidx int, one long, two long")
    return hits.join(t.select("term", "one", "two"), ["one", "two"]).select("term", "function_id", "fidx")
