"""Operators 1, 2, 3, 5 and 10 against brute force on the odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest
import tiktoken

from shelfwise.llm import jaccard_join, pii, quality, substring_dedup, token_counts

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return (text or "").encode().split()


# ---- 1


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j:j + 5]) for j in range(len(w) - 4)])


def brute_roots(rows):
    """Set sizes, and for every row a row that stands for its component."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    return [len(s) for s in sets], [find(k) for k in range(len(rows))]


def brute_components(rows):
    sizes, roots = brute_roots(rows)
    low = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, n, low.get(r)) for (i, _), n, r in zip(rows, sizes, roots)), key=str)


def test_jaccard_join_equals_brute_force(odd_docs, odd_rows):
    got = sorted((tuple(r) for r in jaccard_join.components_of(odd_docs).collect()), key=str)
    assert got == brute_components([r[:2] for r in odd_rows])


def test_trie_finds_links_between_all_components():
    import random

    import numpy as np
    rng = random.Random(5)
    for _ in range(30):
        sets = []
        for _ in range(rng.randint(2, 25)):
            if sets and rng.random() < 0.6:
                s = set(rng.choice(sets))
                for _ in range(rng.randint(0, 4)):
                    s.discard(rng.choice(sorted(s)))
                    s.add(rng.randint(1, 200))
            else:
                s = set(rng.sample(range(1, 200), rng.randint(1, 30)))
            sets.append(s or {1})
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        links = jaccard_join.trie_links(np.array([len(s) for s in sets]), list(range(len(sets))), arrays)
        assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)

        def parts(pairs):
            up = list(range(len(sets)))

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x
            for a, b in pairs:
                up[find(a)] = find(b)
            out = defaultdict(set)
            for k in range(len(sets)):
                out[find(k)].add(k)
            return sorted(map(sorted, out.values()))

        every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        assert parts(links) == parts(every)


def test_sets_that_bounds_exclude_do_not_meet(spark):
    """Postings of one template token: of sets that are all alike in size and too far on to link no pair
    meets; of others those pairs meet that length and position allow."""
    import random
    rng = random.Random(4)
    far = [(1, i, 100, 75) for i in range(200)]
    some = [(2, 1000 + i, n, n - 1 - rng.randint(0, n // 4)) for i, n in enumerate(rng.choices(range(1, 200), k=150))]
    df = spark.createDataFrame(far + some, "token long, cid long, n long, rest long")
    got = jaccard_join._meeting(df).collect()
    want = {frozenset((a[1], b[1])) for a in some for b in some
            if a[1] < b[1] and 4 * min(a[2], b[2]) >= 3 * max(a[2], b[2]) and 1 + min(a[3], b[3]) >= jaccard_join.need(a[2], b[2])}
    assert len(got) == len(want) and {frozenset((r["a_cid"], r["b_cid"])) for r in got} == want and len(want) > 100
    larger, smaller = jaccard_join._dealt(df.where("token = 1"))
    assert larger.join(smaller, (larger["a_token"] == smaller["b_token"]) & (larger["band"] == smaller["band"])).count() == 0


def test_links_of_every_document_equal_brute_force(odd_docs, odd_rows):
    """Links inside components too: of 30 near copies some do not link with each other."""
    sets = [shingles(r[1]) for r in odd_rows]
    want = sorted(((r[0], sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 75 * len(a | b)))
                   for i, (r, a) in enumerate(zip(odd_rows, sets))), key=str)
    assert sorted((tuple(r) for r in jaccard_join.link_counts(odd_docs).collect()), key=str) == want
    assert max(n for _, n in want) > 3


def test_one_row_of_each_group_stays(odd_docs, odd_rows):
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    _, roots = brute_roots([r[:2] for r in odd_rows])       # rows without words are components of their own
    assert kept.count() == len(set(roots))


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join.components_of(no_docs).count() == 0
    assert jaccard_join.one_of_each(no_docs).count() == 0


# ---- 2

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, rx in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = ["a@b.c_x@y.z call (555) 123-4567 now", "1.2.3.4.5.6.7.8 " * 200, "x (at) foo.com or joe[at]bar[dot]de", "é" * 50 + " +49 (0) 30 1234567 ü 4111 1111 1111 1111é",
       "256.1.1.1 a@b@c.d 001.002.003.0004 99999999999999.1.1.1", "+1 2", "+1" + " " * 500, "a.b" * 300 + "@", "4111-1111 1111-1111 5500005555555559 12345678901234567890",
       "..@..a.b@-.-", "%@a.b.c.@d.e", "+123456789+1234567890 +(1)", "1.1.1.256 1.1.1.25.6"]


def test_base_spans_equal_brute_force(spark, odd_rows):
    from pyspark.sql import types as T
    texts = PII + [r[1] for r in odd_rows]
    df = spark.createDataFrame(list(enumerate(texts)), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    for r in pii.detect(df).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], r)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        every = [s for s in r["spans"].split(",") if s]
        assert set(want) <= set(every) and len(every) == len(want) + r["n_added"]
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_redaction(spark, odd_docs, no_docs):
    out = pii.redacted(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = out.where("doc_id = 14").first()["text"]
    assert text.startswith("mail <EMAIL>, <PHONE>; <CARD> or <IP>. ")
    row = out.where("doc_id = 9").first()
    assert row["n_chars"] == len(row["text"])
    assert out.where("text is null").count() == 2
    assert pii.redacted(no_docs).count() == 0 and pii.detect(no_docs).count() == 0


def test_em_trusts_labelers_that_agree():
    import numpy as np
    votes = np.array([[1, 1, 1], [1, 1, -1], [-1, -1, 1], [-1, -1, -1]])
    p = pii.estimate(votes, np.array([500.0, 500.0, 500.0, 500.0]))
    assert p[0] > 0.9 and p[1] > 0.9 and p[2] < 0.1 and p[3] < 0.1      # the third votes at random


# ---- 3


def test_substring_dedup_equals_brute_force(odd_docs, odd_rows):
    top = 1 << 63
    low = {}
    for i, t, *_ in odd_rows:
        w, i = words(t), top if i is None else i
        for j in range(len(w) - 49):
            k = tuple(w[j:j + 50])
            low[k] = min(low.get(k, i), i)
    want = []
    for i, t, *_ in odd_rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if low[tuple(w[j:j + 50])] < (top if i is None else i):
                gone[j:j + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    got = [tuple(r) for r in substring_dedup.dedup(odd_docs, with_text=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 100


def test_substring_dedup_in_small_buckets(spark, monkeypatch):
    """Many slices and buckets: passages that many documents share, at different places."""
    import random
    rng = random.Random(2)
    passages = [[f"q{p}_{i}" for i in range(rng.randint(50, 120))] for p in range(5)]
    rows = []
    for d in range(120):
        w = [f"u{d}_{i}" for i in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            w[rng.randint(0, len(w)):0] = rng.choice(passages)
        rows.append((d, " ".join(w)))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    low = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            low.setdefault(tuple(w[j:j + 50]), i)
    for r in substring_dedup.dedup(df).collect():
        w = words(rows[r["doc_id"]][1])
        gone = set()
        for j in range(len(w) - 49):
            if low[tuple(w[j:j + 50])] < r["doc_id"]:
                gone |= set(range(j, j + 50))
        assert r["n_removed"] == len(gone)


def test_substring_dedup_deals_a_common_passage(spark, monkeypatch):
    """One passage in all documents, between their own words: no bucket gathers the runs that straddle
    its start, and the result is that of brute force."""
    import random
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(600):
        own = [f"u{d}_{i}" for i in range(rng.randint(50, 80))]
        cut = rng.randint(0, len(own))
        rows.append((d if d % 50 else None, " ".join(own[:cut] + passage + own[cut:])))
    rows += rows[:20] + [(7, rows[9][1]), (3, " ".join(passage[:50] * 3)), (1000, "w " * 300), (1001, "w " * 200)]
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = {r[0]: r[1] for r in substring_dedup.packed_windows(df).selectExpr("bucket", "length(blob) AS n").groupBy("bucket").sum("n").collect()}
    assert len(size) == 16 and max(size.values()) < 1.5 * sum(size.values()) / 16
    top, low = 1 << 63, {}
    for i, t in rows:
        w, i = words(t), top if i is None else i
        for j in range(len(w) - 49):
            key = tuple(w[j:j + 50])
            low[key] = min(low.get(key, i), i)
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - 49):
            if low[tuple(w[j:j + 50])] < (top if i is None else i):
                gone |= set(range(j, j + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in substring_dedup.dedup(df).collect())


def test_substring_dedup_of_nothing(no_docs):
    assert substring_dedup.dedup(no_docs).count() == 0


# ---- 5


def base_stats(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
    covered = set()
    for j, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= set(range(j, j + 8))
    n_repeat = len(covered)
    return {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": n_repeat,
            "base_failed": len(w) < 20 or 100 * n_repeat > 30 * len(w)}


def test_quality_statistics_equal_brute_force(odd_docs, odd_rows):
    short = [r for r in odd_rows if len(words(r[1])) < 3000]
    got = quality.assess(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = sorted(str((r[0], sorted(base_stats(r[1]).items()))) for r in short)
    names = set(base_stats(""))
    mine = sorted(str((r["doc_id"], sorted((k, v) for k, v in r.asDict().items() if k in names))) for r in got if r["n_words"] < 3000)
    assert mine == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_keeps_prose_and_drops_junk(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    rows = quality.assess(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert not kept.where("text is null or n_chars = 0").count()
    assert quality.assess(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


# ---- 10


@pytest.fixture(scope="module")
def encoder():
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_edits_count_like_encoding_anew(encoder):
    import random
    rng = random.Random(3)
    counter = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    from tests.llm.conftest import prose
    for text in ["", " ", "a" * 800, "   " * 200, "don't  stop\n\n  now 漢字 é 123abc" * 30, prose(900, 1)]:
        leaves = counter.leaves(counter.rx.findall(text))
        tree = token_counts.TokenTree(counter, [t for t, _ in leaves], [n for _, n in leaves])
        for _ in range(60):
            a = rng.randint(-2, len(text) + 3)
            b = a + rng.choice([0, 1, 3, 20, 500])
            new = rng.choice(["", "x", " ", "\n", "  ", "'s", " foo bar", "12", " \n ", "!!", "word " * 400, None])
            start = min(max(a, 0), len(text))
            text = text[:start] + (new or "") + text[min(max(b, start), len(text)):]
            tree.edit(a, b, new)
            assert "".join(tree.texts) == text and tree.tokens[1] == len(encoder.encode_ordinary(text))
            assert tree.chars[1] == len(text) and sum(tree.leaf_tokens) == tree.tokens[1]


def test_token_counts_on_odd_rows(odd_docs, odd_rows, no_docs, encoder):
    counted = token_counts.count_tokens(odd_docs)
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in counted.collect()) == sorted(
        str((r[0], len(encoder.encode_ordinary(r[1] or "")))) for r in odd_rows)
    from pyspark.sql import functions as F
    edits = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("stop"), F.lit(" new words").alias("text")),
                    F.lit(None), F.struct(F.lit(None).alias("start"), F.lit(None).alias("stop"), F.lit(None).alias("text")))
    for r in token_counts.apply_edits(counted.withColumn("edits", edits)).collect():
        assert r["n_tokens"] == len(encoder.encode_ordinary(r["text"])) == sum(r["tree"]["tokens"])
    assert token_counts.edited_counts(odd_docs).count() == len(odd_rows)
    assert token_counts.edited_counts(no_docs).count() == 0


def test_hot_minimisers_are_a_filter_of_fixed_size(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F
    common = " ".join(f"c{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{common} own {i} " + " ".join(f"w{i}x{j}" for j in range(55))) for i in range(300)], "doc long, text string")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", 100)
    hot = substring_dedup.hot_minimisers(docs, total)
    w = substring_dedup.Words(*substring_dedup.buffers(pa.array([common])))
    assert hot.test(np.unique(substring_dedup.super_kmers(w)[3])).all()
    assert 1 <= len(hot) <= 60             # the common passage's and its edge's, no document's own
    none = substring_dedup.hot_minimisers(docs.limit(0), 0)
    assert len(none) == 0 and not none.test(np.arange(9, dtype=np.uint64)).any() and 7 not in none
    # With twice the text, a hot minimiser takes twice the documents: the number of hot ones stays.
    monkeypatch.undo()
    big = substring_dedup.RUN_BYTES * substring_dedup.MOST_HOT * substring_dedup.HOT_RUNS
    assert substring_dedup.hot_runs(big // 2) == substring_dedup.hot_runs(big) == substring_dedup.HOT_RUNS
    for size in (2 * big, 100 * big):
        assert size / substring_dedup.RUN_BYTES / substring_dedup.hot_runs(size) <= substring_dedup.MOST_HOT * 1.001
    # All bits, the last too, come back from the words.
    keys = np.array([0, 63, (1 << 26) - 1, (1 << 64) - 1, 1 << 40], dtype=np.uint64)
    spot = keys & np.uint64((1 << 26) - 1)
    index, inverse = np.unique(spot >> np.uint64(6), return_inverse=True)
    words = np.zeros(len(index), np.uint64)
    np.bitwise_or.at(words, inverse, np.uint64(1) << (spot & np.uint64(63)))
    all_of = substring_dedup.Hot(index.astype(np.int64), words.view(np.int64))
    assert all_of.test(keys).all() and not all_of.test(np.array([1, 62, 64], np.uint64)).any()
