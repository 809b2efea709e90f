import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm.common import Words, covered, slices, window_hashes, window_rows

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té漢\x0b\x1c", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    arr = pa.array(texts, pa.string())
    w = Words.of(arr)
    raw = w.raw.tobytes()
    for d, t in enumerate(texts):
        want = (t or "").encode().split()          # bytes.split: exactly 0x20 and 0x09-0x0D
        got = [raw[w.starts[i]:w.ends[i]] for i in range(w.first[d], w.first[d + 1])]
        assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=40), min_size=1, max_size=20))
def test_equal_words_and_windows_have_equal_hashes(words):
    w = Words.of(pa.array([" ".join(words)]))
    h = w.hashes()
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (h[i] == h[j]) == (a == b)
    for k in (2, 3, 5, 8):
        x = window_hashes(h, k)
        for i in range(len(x)):
            for j in range(len(x)):
                assert (x[i] == x[j]) == (words[i:i + k] == words[j:j + k])


def test_lower_case_touches_ascii_letters_only():
    a, b = Words.of(pa.array(["ABZ É[@"]), lower=True), Words.of(pa.array(["abz É[@"]))
    assert (a.hashes() == b.hashes()).all()


def test_windows_stay_within_rows():
    at, row = window_rows(np.array([0, 3, 3, 8]), 3)
    assert at.tolist() == [0, 3, 4, 5] and row.tolist() == [0, 2, 2, 2]
    assert covered(8, np.array([0, 5]), 2).tolist() == [True, True, False, False, False, True, True, False]


def test_slices_cover_the_batch_in_order():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * k for k in (5, 0, 100, 1, 1, 50)] + [None]})
    parts = list(slices(batch, "t", 10))
    assert [v for p in parts for v in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert len(parts) > 1 and all(p.num_rows for p in parts)


def test_drawn_rows_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from shelfwise.llm.common import drawn
    df = spark.range(5000)
    draw = F.xxhash64(F.lit(1), F.col("id"))
    want = [r["id"] for r in df.withColumn("h", draw).orderBy("h").limit(40).collect()]
    for parts in (1, 9):
        assert [r["id"] for r in drawn(df.repartition(parts), draw, 40)] == want
    assert len(drawn(df.limit(7), draw, 40)) == 7 and drawn(df.limit(0), draw, 40) == []


def test_columns_named_like_the_operators_own(spark):
    """Every operator that passes columns on keeps those that have the names it uses itself."""
    from pyspark.sql import functions as F

    from shelfwise.llm import jaccard_join, mixing, pii, quality, token_counts
    text = " ".join(f"the word{i} of it." for i in range(40)) + " mail a.b@example.org now"
    names = ["_own", "_OWN_", "_jac_doc", "_jac_key", "_pii_text", "_pii_email", "_PII_base", "_quality", "_mix_source", "_mix_epochs", "_count_text", "given0", "keep_doc"]
    docs = spark.createDataFrame([(1, text, "a", 5), (2, text + " x", "b", 5), (3, None, "a", 5)], "doc_id long, text string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    counted = token_counts.count_tokens(docs).withColumn("edits", F.lit(None).cast(token_counts.EDITS))
    for out in (jaccard_join.one_of_each(docs), pii.redacted(docs), quality.keep_good(docs), mixing.mixed(docs), token_counts.apply_edits(counted)):
        rows = out.collect()
        assert rows and out.columns[:3] == docs.columns[:3] or set(docs.columns) <= set(out.columns)
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in names)
    assert "a.b@" not in pii.redacted(docs).first()["text"]


def test_deep_pages_parse_in_linear_time():
    import time

    from shelfwise.llm.html_text import Page
    n = 20_000
    for page in ("<div>" * n + "x", "<p>" + "<div>" * n + "</p>" * n, "<svg>" + "<g>" * n, "<ul>" + "<li><div>" * n, "<b>" * n + "</i>" * n,
                 "<noscript>" + "<p>x</p>" * n, "<head><noscript>" + "<p>x</p>" * n + "</noscript>"):
        start = time.process_time()
        Page(page).features()
        assert time.process_time() - start < 3, page[:12]


def test_units_of_texts_with_and_without_zero_characters():
    from shelfwise.llm.piece_sampling import units_of
    for text in ("a  b\nc é", "a\0 b\0\0c", "", "\0", "   ", "x"):
        units, number, _ = units_of([text])
        joined = "".join(units[k] for k in number)
        assert joined.replace("▁", " ").strip(" ") == text.strip(" ")
