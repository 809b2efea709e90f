"""The training-corpus pipeline: five operators in a row, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs.  All stages but the last return the
columns of ``documents``.  A column that the operators name (doc_id, text, source, n_chars) keeps its
meaning; others pass through.  Nulls, empty texts, ties and repeated rows are handled as each operator
states; in short: documents without words fail the quality rules, one row of each group of near copies
stays, a document may be repeated by the mix, and every copy is encoded alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import jaccard_join, mixing, piece_sampling, pii, quality
from shelfwise.llm.common import table, written
from shelfwise.session import apply_conf


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base checks or the estimated verdict reject go."""
    apply_conf(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group linked at Jaccard 0.75 on 5-word shingles stays."""
    apply_conf(spark)
    return jaccard_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: spans of personal data become marks; ``n_chars`` follows."""
    apply_conf(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: sources are repeated towards equal shares, at most twice; no document is lost."""
    apply_conf(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: two distinct sampled segmentations of every row."""
    apply_conf(spark)
    return piece_sampling.encode_samples(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: No SQL: EM, the trie join's components and the sampler are iterative.  tests/llm checks the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
