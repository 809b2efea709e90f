"""Rows that every operator has to stand: nulls, empty and very long texts, ties, repeated rows, and
extra columns whose names the operators use themselves."""

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the operators' own.
CLASHING = {"key": "x", "id": "y", "label": "z", "tokens": "t", "text_key": "k", "n": "n", "tree": "r", "epochs": "e", "spans": "s",
            "kept": "kk", "rank": "rr", "doc": "dd", "row": "ro", "tokens_": "to", "rule": "ru", "n_words": "w"}


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    stems = ["tion", "er", "re", "an", "on", "es", "ti", "st", "en", "nd"]
    out = []
    for k in range(words):
        out.append(rng.choice(["the", "of", "and", "to", "".join(rng.choices(stems, k=rng.randint(1, 4)))]))
        if k % 11 == 10:
            out[-1] += "."
        if k % 40 == 39:
            out[-1] += "\n"
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    passage = " ".join(f"p{i}" for i in range(60))
    base = prose(150, 1).split()
    near = []
    for i in range(30):
        rng = random.Random(i)
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(50)}"
        near.append(" ".join(words))
    rows = [(None, None, None, None, None), (None, prose(80, 2), "en", None, 5), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4),
            (4, "one", "en", "b", 3), (5, "ONE", "en", "b", 3), (6, "a b c d e", "en", None, 9), (7, "A B\tc\nd  e", "en", "b", 11),
            (8, passage, "en", "c", 1), (9, "x " + passage + " y " + prose(30, 3), "en", "c", 1), (10, passage + "\n" + passage, "en", "c", 1),
            (11, "z" * 60000, "en", "c", 60000), (12, "w " * 20000, "en", "c", 40000), (13, "9" * 5000, "en", "c", 5000),
            (14, "mail a.b@c-d.example.org, +1 (555) 123-4567; 4111 1111 1111 1111 or 10.0.0.1. " + prose(60, 4), "en", "d", 1),
            (15, "é ü 漢字 𝄞 ½ ▁ " + prose(40, 5), "fr", "d", 1), (15, "é ü 漢字 𝄞 ½ ▁ " + prose(40, 5), "fr", "d", 1), (15, prose(90, 6), "fr", "d", 1),
            (16, "SHOUT!! " * 60, "en", "d", 1), (17, "\n".join(["the same line again and again"] * 40), "en", "d", 1)]
    rows += [(100 + i, prose(120, 100 + i), "en", "e" if i % 3 else "f", 1) for i in range(40)]
    rows += [(300 + i, t, "en", "e", 1) for i, t in enumerate(near)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
