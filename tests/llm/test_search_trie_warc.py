"""Operators 11 to 13 against brute force, on odd rows and on the tables."""

import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import prefix_trie, ranked_search, warc
from tests.llm.conftest import CLASHING, DOCUMENTS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
MAX_ID = (1 << 63) - 1


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


# ---------------------------------------------------------------- ranked search

def brute_ranking(docs, items, k=50):
    """docs: (id, text), items: (id, text)."""
    held = [(MAX_ID if i is None else i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    n_docs, n_terms, df = sum(bool(t) for _, t in held), sum(len(t) for _, t in held), {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = set()
    for item, terms in asked.items():
        scored = []
        for doc, t in held:
            m, score = 50 + (50 * len(t) * n_docs) // max(n_terms, 1), 0
            for x in terms & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc))
        out |= {(item, r + 1, None if d == MAX_ID else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def ranking(docs, items, k=50, **how):
    terms = ranked_search.written(ranked_search.item_terms(items), "terms")
    wanted = ranked_search.term_filter(terms) if how.pop("filter", True) else None
    return {tuple(r) for r in ranked_search.search(ranked_search.build(docs, wanted, **how), terms, k).collect()}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, prose(12, 1)), (2, "the THE tion"), (2, "of nowhere"), (3, None), (4, ""), (None, "the"), (5, "zzzz nosuchterm"),
            (6, "漢字 é É 𝄞"), (7, "the of and to"), (8, prose(60, 100)), (9, "9" * 5000)]
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in ("term", "score", "block", "items")})


def test_ranked_search_on_odd_rows(odd_rows, odd_docs, items):
    from pyspark.sql import functions as F
    docs = odd_docs.withColumns({c: F.lit("x") for c in ("shard", "term", "heads", "id")})
    want = brute_ranking([r[:2] for r in odd_rows], [(r["item_id"], r["text"]) for r in items.collect()])
    got = {tuple(r) for r in ranked_search.ranked(docs, items).collect()}
    assert got == want and len(got) > 150
    assert {r[:2] for r in got if r[0] == 5} == set() and not any(r[0] in (3, 4) for r in got)


@pytest.mark.parametrize("k,block,items_a_block,shard_bytes", [(3, 4, 2, 300), (1, 1, 1, 5000), (50, 128, 256, 2000)])
def test_ranked_search_with_small_blocks_and_shards(odd_rows, odd_docs, items, monkeypatch, k, block, items_a_block, shard_bytes):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "ITEMS", items_a_block)
    want = brute_ranking([r[:2] for r in odd_rows], [(r["item_id"], r["text"]) for r in items.collect()], k)
    assert ranking(odd_docs, items, k, shard_bytes=shard_bytes, filter=k != 3) == want


def test_ranked_search_of_empty_tables(spark, odd_docs, no_docs, items):
    assert ranked_search.ranked(no_docs, items).collect() == []
    assert ranked_search.ranked(odd_docs, items.limit(0)).collect() == []
    assert ranked_search.ranked(spark.createDataFrame([(1, None, None, None, None), (2, "--", "en", "a", 2)], DOCUMENTS), items).collect() == []


def test_blocks_are_rejected_before_they_are_decompressed():
    """One rare term marks a document; of a frequent term's many blocks only those with found documents are opened."""
    rng = np.random.default_rng(3)
    n = 4000
    texts = ["common " + " ".join(f"w{rng.integers(50)}" for _ in range(20)) + (" rare" * 3 if i % 800 == 7 else "") for i in range(n)]
    batch = ranked_search.pack_shard(np.arange(n), pa.array(texts), 0, None)
    rows = {r["term"]: r for r in batch.to_pylist()}
    lengths, stats = np.frombuffer(rows[None]["data"], np.int64), (rows[None]["n_docs"], rows[None]["n_terms"])
    lists = {}
    for word, weight in (("rare", 6000), ("common", 3)):
        h = ranked_search.term_hashes(pa.array([word]))[0].view(np.int64)[0]
        p = ranked_search.Postings(weight, rows[h]["heads"], rows[h]["data"], lengths, stats)
        lists[word] = (int(p.bounds.max()), p)
    nothing = (np.zeros(0, np.int64),) * 2
    scores, docs = ranked_search.best_of_shard(list(lists.values()), np.arange(n), nothing, 3)
    assert set(docs.tolist()) <= set(range(7, n, 800)) and len(docs) == 3 and (np.diff(scores) <= 0).all()
    opened = sum(x is not None for x in lists["common"][1].open)
    assert len(lists["common"][1].open) == 32 and opened <= 5
    whole = lists["rare"][1].all()
    d, s = lists["common"][1].all()
    total = np.zeros(n, np.int64)
    np.add.at(total, whole[0], whole[1])
    np.add.at(total, d, s)
    best = np.lexsort((np.arange(n), -total))[:3]
    assert best.tolist() == docs.tolist() and total[best].tolist() == scores.tolist()


def test_a_later_shard_is_left_by_the_threshold_of_the_first():
    texts = ["apple pear " * 5] * 5 + ["apple"] * 300
    one = ranked_search.pack_shard(np.arange(305), pa.array(texts), 0, None)
    rows = {r["term"]: r for r in one.to_pylist()}
    lengths = np.frombuffer(rows[None]["data"], np.int64)
    h = ranked_search.term_hashes(pa.array(["apple"]))[0].view(np.int64)[0]
    p = ranked_search.Postings(10, rows[h]["heads"], rows[h]["data"], lengths, (305, 350))
    high = (np.full(5, 10 ** 9), np.arange(5))
    assert ranked_search.best_of_shard([(int(p.bounds.max()), p)], np.arange(305), high, 5) is high
    assert all(x is None for x in p.open)


def test_filter_has_every_term(spark):
    terms = spark.range(3000).selectExpr("xxhash64(id) AS term").union(spark.createDataFrame([(-1,), (0,), (MAX_ID,), (-MAX_ID - 1,)], "term long"))
    bits = ranked_search.term_filter(terms)
    h = np.array([r["term"] for r in terms.collect()], np.int64).view(np.uint64)
    one, two = ranked_search._spots(h)
    assert bits[one].all() and bits[two].all() and len(bits) == ranked_search.FILTER_BITS and bits.sum() <= 2 * len(h)


# ---------------------------------------------------------------- prefix trie

def brute_trie(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    seqs = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(conv.get(c - int(math.fmod(c, 100)), [])[:h] + conv[c][h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def turns_of(spark, rows, parts=5):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return df.withColumns({c: F.lit("x") for c in ("ref", "part", "depth", "chars", "base", "pos", "s0", *CLASHING) if c not in df.columns})


ODD_TURNS = ([(None, 0, "user", "lost"), (7, None, "user", "first"), (7, None, None, None), (7, 2, "user", "b"), (7, 2, "user", "b"), (7, 2, "user", "a"),
              (-150, 0, "user", "neg"), (-200, 0, "user", "base"), (-200, 1, "a", "x"), (300, 0, "", ""), (301, 0, None, None), (302, 5, "u/1", "2"), (303, 5, "u", "/12"),
              (400, 0, "user", "é漢𝄞")]
             + [(c, t, "user" if t % 2 else "assistant", f"t{t}") for c in range(500, 560) for t in range(7)]            # copies
             + [(c, t, "u", f"t{t}" if t < c % 9 else f"{c}") for c in range(600, 660) for t in range(9)]               # shared heads
             + [(700, t, "u", f"long {t % 3}") for t in range(400)] + [(701, t, "u", f"long {t % 3}") for t in range(397)])


def test_trie_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "ENDS_CHUNK", 100)
    got = sorted(map(tuple, prefix_trie.trie(turns_of(spark, ODD_TURNS)).collect()), key=key)
    assert got == brute_trie(ODD_TURNS)


def test_a_long_conversation_is_dealt_to_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(100, t, "u", f"{t}") for t in range(3000)]
        turns = prefix_trie.stored_turns(turns_of(spark, rows))
        _, parts = prefix_trie._products(turns, 0)
        assert parts.count() > 1                 # one conversation, several ranges
        got = sorted(map(tuple, prefix_trie.trie(turns_of(spark, rows)).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_trie(rows)


def test_trie_on_the_table_and_empty(spark, sf_dir):
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = list(map(tuple, convs.select("conv_id", "turn", "role", "text").collect()))
    assert sorted(map(tuple, prefix_trie.trie(convs).collect()), key=key) == brute_trie(rows)
    assert prefix_trie.trie(convs.limit(0)).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 == 5][:3]      # no base, one turn
    got = prefix_trie.trie(turns_of(spark, [(c, 0, "u", "x") for c in short])).collect()
    assert [tuple(r) for r in got] == [(min(short), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_unequal_turns_under_one_fingerprint_are_found(spark):
    turns = spark.createDataFrame([(1, 1, "u", "a"), (2, 2, "u", "b"), (3, 3, "u", "a")], "ref long, conv_id long, role string, text string")
    def mixed(*refs):
        return spark.createDataFrame([(r, 1, r, 1, 9, 9, 9, 0, 0, 0) for r in refs],
                                     "conv_id long, depth long, ref long, chars long, s0 long, s1 long, s2 long, q0 long, q1 long, q2 long")
    assert prefix_trie.mismatches(turns, mixed(1, 2)) == 1 and prefix_trie.mismatches(turns, mixed(1, 3)) == 0


def test_fingerprints_compose(spark):
    """The product of a whole is that of its parts, wherever it is cut."""
    from pyspark.sql import functions as F
    n = [0, 1, 15, 16, 255, 4096, 123_456_789, (1 << 36) - 1]
    for b in prefix_trie.BASES:
        got = spark.createDataFrame([(x,) for x in n], "n long").select("n", prefix_trie._power(b, F.col("n")).alias("p")).collect()
        assert {r["n"]: r["p"] for r in got} == {x: pow(b, x, prefix_trie.P) for x in n}


# ---------------------------------------------------------------- WARC

LONG = "x" * 120
ODD_PAGES = ([(1, "http://a/ b\n", LONG), (2, None, LONG), (None, "u", LONG), (1, "u2", LONG), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\n"), (6, "u", "a\r\n\r\nb\r\n"),
              (7, "u", "\r\n" * 100), (8, "u", "\r\n" * 100), (9, "u", LONG + "\r"), (10, "u", LONG + "\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", "é漢𝄞" * 60), (-4, "u", "é漢𝄞" * 60),
              (12, "u", "﻿" + LONG), (13, "u", "\x00\x0b\x85" * 50), (14, "u", "q" * 3_000_000), (15, "u", "\r\r\n\r\n\r\r\n" * 30), (16, "u", "s" * 99), (17, "u", "s" * 99),
              (None, "u", "n" * 100), (None, "u", "n" * 100)] + [(100 + i, "u", LONG) for i in range(50)])


def brute_records(rows):
    low, top = {}, 1 << 70
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            low[b] = min(low.get(b, top), top if p is None else p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in low and (top if p is None else p) > low[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low[b] if again else None))
    return sorted(out, key=key)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def pages_of(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns(
        {c: F.lit("x") for c in ("id", "digest", "size", "original", "payload", "record", "block")})


def test_records_read_back(spark, tmp_path):
    warc.write_archives(pages_of(spark, ODD_PAGES), str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in warc.resolved(records).select(*COLUMNS).collect()), key=key)
    assert got == brute_records(ODD_PAGES)
    whole = sorted(((r["page_id"], r["payload"]) for r in warc.with_payloads(records).collect()), key=key)
    assert whole == sorted(((p, h or "") for p, _, h in ODD_PAGES), key=key)
    urls = {r["page_id"]: r["url"] for r in records.where("page_id in (2, 9)").collect()}
    assert urls == {2: None, 9: "u"}
    assert {r["url"] for r in records.where("page_id = 1").collect()} == {"http://a/%20b%0A", "u2"}


def test_archives_are_valid_and_hold_a_payload_once(spark, tmp_path):
    """A reader of plain bytes, by the letter of the format: version, headers, block of Content-Length, two line ends."""
    warc.write_archives(pages_of(spark, ODD_PAGES), str(tmp_path / "w"))
    seen, types = [], []
    for f in (tmp_path / "w").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            assert lines[0] == b"WARC/1.1"
            fields = dict(x.split(b": ", 1) for x in lines[1:])
            assert {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields)
            block, data = data[:int(fields[b"Content-Length"])], data[int(fields[b"Content-Length"]):]
            assert data[:4] == b"\r\n\r\n"
            data = data[4:]
            types.append(fields[b"WARC-Type"])
            if fields[b"WARC-Type"] == b"response":
                payload = block.partition(b"\r\n\r\n")[2]
                import base64
                assert base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:") + b"====") == hashlib.sha256(payload).digest()
                seen.append(payload)
            else:
                assert block == b"" and fields[b"WARC-Refers-To"].startswith(b"<urn:page:") and b"WARC-Profile" in fields
    assert len(types) == len(ODD_PAGES) and types.count(b"revisit") == sum(r[3] == "revisit" for r in brute_records(ODD_PAGES))
    assert seen.count(LONG.encode()) == 2                    # both rows of page 1


def test_archives_written_anew(spark, tmp_path):
    """Two archives that do not know of each other become one: payloads that both hold are written once."""
    one, two = ODD_PAGES[:8], [(200 + i, u, h) for i, (_, u, h) in enumerate(ODD_PAGES[:8])]
    for name, rows in (("a", one), ("b", two)):
        warc.write_archives(pages_of(spark, rows), str(tmp_path / "in" / name))
    warc.deduplicated(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), date="2021-02-03T04:05:06Z")
    records = warc.read_archives(spark, str(tmp_path / "out"))
    got = sorted((tuple(r) for r in warc.resolved(records).select(*COLUMNS).collect()), key=key)
    assert got == brute_records(one + two)
    assert {r["date"] for r in records.collect()} == {"2021-02-03T04:05:06Z"}


def test_warc_of_empty_tables_and_missing_originals(spark, tmp_path):
    assert warc.archived(pages_of(spark, ODD_PAGES).limit(0)).collect() == []
    warc.write_archives(pages_of(spark, [(1, "u", LONG), (2, "u", LONG)]), str(tmp_path / "w"))
    lone = warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'revisit'")
    r = warc.resolved(lone).collect()[0]
    assert (r["page_id"], r["payload_bytes"], r["payload_digest"]) == (2, None, hashlib.sha256(LONG.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="\r\na:W", max_size=14), max_size=5))
def test_records_are_cut_by_their_length(blocks):
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b.encode()) for b in blocks)
    pieces = data.split(b"\r\n\r\n")
    if pieces and not pieces[-1]:
        pieces.pop()                       # Spark's reader gives no empty piece at the end
    assert [b.decode() for _, b in warc.split_records(p.decode() for p in pieces)] == blocks


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.split_records(iter(["WARC/1.1\r\nContent-Length: 9", "abc"])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter(["HTTP/1.1 200 OK"])))
