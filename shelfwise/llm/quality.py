"""Operator 5, quality rules: weak supervision over rule votes.

Every rule votes good (1), bad (-1) or abstains (0) on a text's statistics.  The votes of all
documents are counted by pattern (at most 3 ** rules rows), expectation-maximisation on that table
estimates how each rule votes on good and on bad texts, and a text is kept when its posterior
probability of being good reaches ``threshold`` and the base checks hold.

Null and empty texts have no words and fail the base check.  Repeated rows are judged alike; an
empty table gives an empty result and a neutral model.  Extra columns pass through ``keep_good``
unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import Words, aside, covered, per_row, slices, window_hashes, window_rows

REPEAT_WINDOW = 8
MIN_WORDS = 20
THRESHOLD = 0.5
EM_ROUNDS = 100

#: Frequent function words of the four languages (fixed list).
STOP_WORDS = ("the be to of and that with for was this are from der die und das den von mit des auf ist nicht auch "
              "el la de que los las una por con para del le les des est et en une dans pour qui sur pas").split()
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_lower", "n_stop", "n_ends", "n_shouts")
FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in BASE + MORE])


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(of)] = 1
    return out


_IS_SYMBOL, _IS_UPPER, _IS_LOWER = _table(SYMBOLS), _table(range(65, 91)), _table(range(97, 123))
_IS_SPACE = _table([32, *range(9, 14)])
_IS_POINT = 1 - _table(range(0x80, 0xC0))     # bytes that begin a code point


def _stop_hashes() -> np.ndarray:
    return np.unique(Words.of(pa.array([" ".join(STOP_WORDS)])).hashes())


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def text_features(arr: pa.Array, stop: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every text of a slice, over its whole text."""
    w = Words.of(arr)
    rows = len(w.offs) - 1
    hashes = w.hashes()
    solid = 1 - _IS_SPACE[w.raw]
    at, row = window_rows(w.first, REPEAT_WINDOW)
    windows = window_hashes(hashes, REPEAT_WINDOW)[at] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    last = w.raw[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    place = np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)
    lines = np.array([_lines(t) for t in arr.fill_null("").to_pylist()], dtype=np.int64).reshape(rows, 2)
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_row(solid * _IS_POINT[w.raw], w.offs),
        "n_symbols": per_row(_IS_SYMBOL[w.raw], w.offs),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": per_row(covered(len(w), at[twice], REPEAT_WINDOW), w.first),
        "n_lines": lines[:, 0],
        "n_upper": per_row(_IS_UPPER[w.raw], w.offs),
        "n_lower": per_row(_IS_LOWER[w.raw], w.offs),
        "n_stop": per_row(stop[place] == hashes, w.first),
        "n_ends": per_row(np.isin(last, list(b".?!")), w.first),
        "n_shouts": per_row(last == ord("!"), w.first),
    }


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its statistics in a struct column ``_quality``; no shuffle."""
    stop = _stop_hashes()
    names = [f.name for f in FEATURES]
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(at)):
                found = text_features(part.column(at), stop)
                struct = pa.StructArray.from_arrays([pa.array(found[n].astype(np.int64)) for n in names], names=names)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*columns, "_quality"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_quality", FEATURES)]))


def rule_votes(q: Column) -> list[tuple[str, Column]]:
    """(name, vote) of every rule: 1 good, -1 bad, 0 abstains."""
    n = q["n_words"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    letters = q["n_upper"] + q["n_lower"]
    return [
        ("length", vote(n < MIN_WORDS, n >= 40)),
        ("word_length", vote((q["word_chars"] < 2 * n) | (q["word_chars"] > 12 * n), q["word_chars"].between(3 * n, 9 * n))),
        ("symbols", vote(q["n_symbols"] * 8 > n, q["n_symbols"] * 50 <= n)),
        ("dup_lines", vote(q["n_dup_lines"] * 10 > q["n_lines"] * 3, (q["n_dup_lines"] == 0) & (q["n_lines"] > 0))),
        ("repeats", vote(q["n_repeat_words"] * 10 > n * 3, q["n_repeat_words"] * 20 <= n)),
        ("case", vote(q["n_upper"] * 10 > letters * 4, q["n_upper"] * 20 <= letters * 3)),
        ("stop_words", vote((q["n_stop"] * 100 < n * 3) & (n >= MIN_WORDS), q["n_stop"] * 100 >= n * 8)),
        ("sentences", vote((q["n_ends"] * 200 < n) & (n >= 60), (q["n_ends"] > 0) & (q["n_ends"] * 4 <= n))),
        ("shouts", vote(q["n_shouts"] * 10 > n, (q["n_shouts"] * 50 <= n) & (n > 0))),
    ]


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """Two-class EM over vote patterns: log-odds of good, and per rule and vote (-1, 0, 1) the
    log-ratio that the vote adds.  Starts from the share of good votes; one is added to each count."""
    rules = patterns.shape[1]
    if not len(counts):
        return 0.0, np.zeros((rules, 3))
    good = (1 + (patterns == 1).sum(axis=1)) / (2 + (patterns != 0).sum(axis=1))
    good = np.where((patterns == -1).sum(axis=1) >= 2, np.minimum(good, 0.2), good)
    for _ in range(rounds):
        share = np.array([(counts * (1 - good)).sum(), (counts * good).sum()]) + 1
        seen = np.stack([[[(counts * p * (patterns[:, r] == v)).sum() + 1 for v in (-1, 0, 1)] for r in range(rules)]
                         for p in (1 - good, good)])
        chance = np.log(seen / seen.sum(axis=2, keepdims=True))
        weight = chance[1] - chance[0]
        prior = float(np.log(share[1] / share[0]))
        odds = prior + sum(weight[r, patterns[:, r] + 1] for r in range(rules))
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return prior, weight


def fit(featured: DataFrame) -> tuple[float, np.ndarray]:
    """Count the vote patterns of all rows and run EM on the counts."""
    votes = rule_votes(F.col("_quality"))
    rows = featured.groupBy(*[v.cast("int").alias(name) for name, v in votes]).count().collect()
    rows = sorted(tuple(r) for r in rows)      # at most 3 ** 9 of them
    patterns = np.array([r[:-1] for r in rows], dtype=np.int64).reshape(len(rows), len(votes))
    return estimate(patterns, np.array([r[-1] for r in rows], dtype=np.float64))


def posterior(q: Column, model: tuple[float, np.ndarray]) -> Column:
    prior, weight = model
    odds = F.lit(float(prior))
    for (_, vote), w in zip(rule_votes(q), weight):
        odds = odds + F.when(vote == -1, float(w[0])).when(vote == 1, float(w[2])).otherwise(float(w[1]))
    return 1 / (1 + F.exp(-odds))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base statistics, posterior and verdict of every document."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    featured = with_features(narrow, text_col)
    q, model = F.col("_quality"), fit(featured)
    failed = base_failed(q)
    return featured.select(id_col, *[q[c].alias(c) for c in BASE], failed.alias("base_failed"),
                           (~failed & (posterior(q, model) >= threshold)).alias("kept"),
                           posterior(q, model).alias("p_good"))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns; one scan to fit, one to filter."""
    docs, back = aside(docs, "_quality")
    featured = with_features(docs, text_col)
    q, model = F.col("_quality"), fit(featured)
    return featured.where(~base_failed(q) & (posterior(q, model) >= threshold)).drop("_quality").withColumnsRenamed(back)
