"""Operator 2, personal data, with DataFrame functions only.

Base spans come from one pattern per kind and a check (parts of an address, Luhn, digit counts);
matches that fail the check are dropped, with no retry.  They always stay.

The method adds spans.  Candidates are the failed matches and looser patterns (national phone
numbers, bracketed e-mail forms).  Labelers vote on each candidate: patterns of the span, a gazetteer
of number prefixes and reserved networks, and words around it.  Votes of all documents are counted
by pattern (a bounded table), expectation-maximisation estimates the labelers' reliabilities there,
and a logistic classifier over the span's features is trained on the posteriors.  A candidate whose
probability reaches ``threshold`` becomes a span, unless it overlaps a base span.

Extra columns pass through ``redacted``, whatever their names.  Null texts are empty.  Repeated rows get the same spans.  An empty table gives an empty result and
a model that adds nothing.  Offsets are code points, end exclusive.  Positions are prefix sums over
the gaps between matches, in blocks, so a text with very many matches stays linear.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import aside, text_or_empty

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT = 24               # code points looked at before and after a candidate
BLOCK = 64                 # matches summed at once

# The contract's patterns.  The guards keep the leftmost match and stop a search from starting
# again inside a run that has already failed; possessive parts keep long runs linear.
EMAIL_RX = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RX = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_RX = r"[0-9](?:[\x20-]?[0-9])++"
PHONE_RX = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser patterns, for candidates only.
LOOSE_EMAIL_RX = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++"
LOOSE_PHONE_RX = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words near a span that speak for its kind, or for a plain number (fixed lists, four languages).
FOR_WORDS = {"email": "mail|kontakt|contact|correo|courriel", "ip": r"\bip\b|host|server|address|adresse|dirección",
             "card": "card|karte|carte|tarjeta|visa|credit|kredit|amex|master",
             "phone": r"phone|tel\b|tel[.:]|call|fax|mobil|handy|teléfono|téléphone"}
AGAINST_WORDS = r"version|isbn|issn|doi|order|invoice|bestell|rechnung|factura|\bid\b|\bno\.|section|chapter|figure|table|\bv$"
#: First digits of payment cards, and networks that belong to nobody (gazetteers).
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
RESERVED_IP = r"^(?:0+|127|2[4-9][0-9]|[3-9][0-9][0-9])\."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, rx: str) -> Column:
    """array<struct(s, e, m)> of all leftmost non-overlapping matches, code points."""
    kind = "array<struct<s:bigint,e:bigint,m:string>>"
    none = F.array().cast(kind)
    zero = F.lit(0).cast("long")

    def place(found: Column) -> Column:
        part = F.transform(F.arrays_zip(F.slice(found["gaps"], 1, F.size(found["hits"])).alias("g"), found["hits"].alias("h")),
                           lambda x: F.struct(F.length(x["g"]).cast("long").alias("gap"), F.length(x["h"]).cast("long").alias("len"),
                                              x["h"].alias("m")))

        def blocked(part: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(part) - 1) / BLOCK).cast("int")),
                                 lambda b: F.slice(part, b * BLOCK + 1, BLOCK))
            return let(blocks, started)

        def started(blocks: Column) -> Column:
            starts = F.aggregate(blocks, F.array(zero), lambda acc, block: F.concat(
                acc, F.array(F.element_at(acc, -1) + F.aggregate(block, zero, lambda t, x: t + x["gap"] + x["len"]))))
            return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), one))

        def one(block: Column, start: Column) -> Column:
            return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["len"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"),
                                                      (acc["at"] + x["gap"] + x["len"]).alias("e"), x["m"].alias("m")))).alias("out")))["out"]

        return F.when(F.size(found["hits"]) > 0, let(part, blocked)).otherwise(none)

    return let(F.struct(F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("hits"), F.split(text, rx, -1).alias("gaps")), place)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a digit string of 13 to 19 digits."""
    def term(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda t, i: t + term(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.length(digits(m)).between(9, 15)


def gated(text: Column, rx: str) -> Column:
    """``matches``, tried only on texts that hold what every match needs."""
    gate = {EMAIL_RX: text.contains("@"), PHONE_RX: text.contains("+"),
            LOOSE_EMAIL_RX: text.contains("(at)") | text.contains("[at]") | text.contains("(AT)") | text.contains("[AT]")}.get(rx)
    if gate is None:
        gate = F.translate(text, "0123456789", "") != text
    return F.when(gate, matches(text, rx)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string>>"))


def found(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_pii_text`` and, per kind, ``_pii_<kind>``: array<struct(s, e, m, ok)>."""
    out = docs.withColumn("_pii_text", text_or_empty(text_col))
    text = F.col("_pii_text")

    def checked(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"),
                                                     valid(kind, x["m"]).alias("ok")))

    for kind, rx in zip(KINDS, (EMAIL_RX, IP_RX, CARD_RX, PHONE_RX)):
        out = out.withColumn(f"_pii_{kind}", checked(kind, gated(text, rx)))
    return out


def base_spans() -> Column:
    """array<struct(k, s, e)>, by kind and start."""
    def of(kind: str) -> Column:
        return F.transform(F.filter(F.col(f"_pii_{kind}"), lambda x: x["ok"]), lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return F.concat(*map(of, KINDS))


def _candidates(text: Column) -> Column:
    def of(kind: str, spans: Column, loose: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(
            F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(loose).alias("loose"),
            F.lower(F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)).cast("int") + 1,
                                F.least(x["s"], F.lit(CONTEXT)).cast("int"))).alias("before"),
            F.lower(F.substring(text, x["e"].cast("int") + 1, F.lit(CONTEXT))).alias("after")))
    def failed(kind: str) -> Column:
        return of(kind, F.filter(F.col(f"_pii_{kind}"), lambda x: ~x["ok"] & worth(kind, x["m"])), False)

    return F.concat(*map(failed, ("ip", "card", "phone")), of("email", gated(text, LOOSE_EMAIL_RX), True), of("phone", gated(text, LOOSE_PHONE_RX), True))


def worth(kind: str, m: Column) -> Column:
    """Failed matches that may be personal data at all."""
    n = F.length(digits(m))
    return {"ip": F.lit(True), "card": n.between(12, 19), "phone": n.between(7, 17)}[kind]


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``found`` with ``_pii_base`` and ``_pii_more``, the candidates that touch no base span."""
    out = found(docs, text_col).withColumn("_pii_base", base_spans())
    free = F.filter(_candidates(F.col("_pii_text")), lambda x: ~F.exists(
        F.col("_pii_base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return out.withColumn("_pii_more", free)


def labelers(x: Column) -> list[Column]:
    """Votes on a candidate: 1 personal, -1 not, 0 abstains."""
    d = digits(x["m"])
    n = F.length(d)
    k = x["k"]
    near = F.concat(x["before"], F.lit(" \x01 "), x["after"])
    speaks = F.lit(False)
    for i, kind in enumerate(KINDS):
        speaks = speaks | ((k == i) & near.rlike(FOR_WORDS[kind]))
    alone = ~x["before"].rlike(r"[\p{L}\p{N}_.:/=\"'-]$") & ~x["after"].rlike(r"^[\p{L}\p{N}_:/=\"'-]")
    shape = (F.when(k == 2, F.when((n >= 15) & (n <= 16), 1).otherwise(-1))
             .when(k == 1, -1)
             .when(k == 3, F.when(x["loose"] | n.between(9, 15), 1).otherwise(-1))
             .otherwise(1))
    gazetteer = (F.when(k == 2, F.when(d.rlike(CARD_PREFIX), 1).otherwise(0))
                 .when(k == 1, F.when(x["m"].rlike(RESERVED_IP), -1).otherwise(0))
                 .when(k == 3, F.when(d.rlike(r"^0?0?(?:1|[2-9][0-9]{2})"), 1).otherwise(0))
                 .otherwise(0))
    varied = F.size(F.array_distinct(F.split(d, ""))) - 1
    return [shape.cast("int"), gazetteer.cast("int"),
            F.when(speaks, 1).otherwise(0),
            F.when(near.rlike(AGAINST_WORDS), -1).otherwise(0),
            F.when(alone, 1).otherwise(-1),
            F.when(k == 0, 0).when(varied <= 3, -1).when(varied >= 5, 1).otherwise(0)]


def features(x: Column) -> list[Column]:
    """What the classifier sees besides the votes: the kind and whether the pattern was loose."""
    return [x["k"].cast("int"), x["loose"].cast("int")]


N_LABELERS, N_FEATURES = 6, 2


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM over vote patterns: probability of personal data per pattern."""
    p = (1 + (votes == 1).sum(axis=1)) / (2 + (votes != 0).sum(axis=1))
    for _ in range(rounds):
        odds = np.full(len(p), np.log((counts @ p + 1) / (counts @ (1 - p) + 1)))
        for v in votes.T:
            seen = np.array([[counts[v == a] @ w[v == a] + 1 for a in (-1, 0, 1)] for w in (p, 1 - p)])
            seen /= seen.sum(axis=1, keepdims=True)
            odds += np.log(seen[0] / seen[1])[v + 1]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def encode(rows: np.ndarray) -> np.ndarray:
    """One-hot votes and features, with a constant."""
    votes, more = rows[:, :N_LABELERS], rows[:, N_LABELERS:]
    parts = [np.ones((len(rows), 1))]
    parts += [(votes[:, [r]] == a) for r in range(N_LABELERS) for a in (-1, 1)]
    parts += [(more[:, [0]] == k) for k in range(len(KINDS))] + [more[:, [1]] == 1]
    return np.concatenate(parts, axis=1).astype(float)


def train(rows: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on EM's posteriors, by Newton steps on the pattern table."""
    x = encode(rows)
    w = np.zeros(x.shape[1])
    if not len(rows):
        w[0] = -30.0
        return w
    target = estimate(rows[:, :N_LABELERS], counts)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (target - p)) - 0.1 * w
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


def fit(spans: DataFrame) -> np.ndarray:
    """Count the vote patterns of all candidates (at most 3 ** 6 * 8 rows) and train on the counts."""
    one = spans.select(F.explode("_pii_more").alias("x"))
    cols = [c.alias(f"v{i}") for i, c in enumerate([*labelers(F.col("x")), *features(F.col("x"))])]
    rows = sorted(tuple(r) for r in one.select(*cols).groupBy(*[f"v{i}" for i in range(len(cols))]).count().collect())
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(cols) + 1)
    return train(table[:, :-1], table[:, -1].astype(float))


def score(x: Column, w: np.ndarray) -> Column:
    """The classifier's log-odds."""
    w = [float(v) for v in w]
    out = F.lit(w[0])
    for r, vote in enumerate(labelers(x)):
        out = out + F.when(vote == -1, w[1 + 2 * r]).when(vote == 1, w[2 + 2 * r]).otherwise(0.0)
    at = 1 + 2 * N_LABELERS
    for k in range(len(KINDS)):
        out = out + F.when(x["k"] == k, w[at + k]).otherwise(0.0)
    return out + F.when(x["loose"], w[at + len(KINDS)]).otherwise(0.0)


def all_spans(w: np.ndarray, threshold: float = THRESHOLD) -> Column:
    """Base and added spans, sorted by kind and start."""
    added = F.transform(F.filter(F.col("_pii_more"), lambda x: score(x, w) >= float(np.log(threshold / (1 - threshold)))),
                        lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return F.array_sort(F.concat(F.col("_pii_base"), added))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""
    spans = with_spans(docs.select(F.col(id_col), F.col(text_col)), text_col)
    w = fit(spans)

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(f"_pii_{kind}"), lambda x: x["ok"])).cast("long").alias(f"n_{kind}")

    every = all_spans(w, threshold)
    return spans.select(id_col, *map(count, KINDS), F.sha2(listed(F.col("_pii_base")), 256).alias("base_sha256"),
                        listed(every).alias("spans"), (F.size(every) - F.size("_pii_base")).cast("long").alias("n_added"))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become the
    first one's mark.  ``chars_col`` follows the new text.  A null text stays null."""
    docs, back = aside(docs, "_pii_")
    spans = with_spans(docs, text_col)
    w = fit(spans)
    text, names = F.col("_pii_text"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # By start; of those that start together, the longest.
    in_order = F.array_sort(F.transform(all_spans(w, threshold), lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("back"), x["e"].alias("e"), x["k"].alias("k"))))

    def cut(start: Column, end: Column) -> Column:
        return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(new, F.concat(acc["out"], cut(acc["at"], x["s"]), names[x["k"]])).otherwise(acc["out"]).alias("out"))

    done = let(F.aggregate(in_order, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step),
               lambda r: F.concat(r["out"], cut(r["at"], F.length(text).cast("long"))))
    out = spans.withColumn(text_col, F.when(F.col(text_col).isNull(), F.col(text_col)).when(F.size("_pii_base") + F.size("_pii_more") == 0, text).otherwise(done))
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(
            F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumnsRenamed(back)
