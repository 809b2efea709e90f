"""Operator 3, substring dedup: super-k-mers of words.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash of its ``M``-word pieces;
consecutive windows that share it form a super-k-mer, which travels as one packed string (the bytes
of its words) to the bucket of its minimiser.  Equal windows have equal minimisers, so they meet in
one bucket, where sorting brings them together: the least document of each window is exact.

Skew: of super-k-mers that are equal inside one slice of a task only the least document's travels as
text; the others are decided there, since a smaller document holds the same windows, and their ranges
go to a bucket of their document.  Where a run straddles the start of a common passage its text is
each document's own, so a minimiser that ``HOT_RUNS`` documents or more hold, as a sample of whole
documents estimates, does not gather its runs: each of its windows goes by its own hash, as 128 bits
without text, and per slice only the least document's.  Which minimisers are hot is known before any
text is packed, as a filter of fixed size: ``HOT_RUNS`` grows with the input beyond some 1.3 TB, so that
no more than about ``MOST_HOT`` are.  Tasks ask the same filter, so equal windows still meet, also those of
a minimiser that it takes for hot by mistake; sample and filter decide on routes, never on results.  What
still gathers is one window in many rows that share one id.

Null and empty texts have no words and nothing removed.  Rows that share an id count as one document
and windows are judged by id; a null id counts as the largest.  Texts under ``WINDOW`` words keep all
words.  An empty table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Words, buffers, mix, slices, text_or_empty, window_hashes, window_rows

WINDOW = 50
M = 4                      # words of the pieces that minimisers are chosen from
BUCKET_BYTES = 10 << 20    # packed strings that a bucket holds on average
EXPANSION = 3.1            # packed bytes for each byte of text
HOT_RUNS = 2048            # documents with one minimiser from which its windows are dealt one by one
SAMPLE_BYTES = 64 << 20    # text whose minimisers are counted for that, at least ...
SAMPLE_HITS = 16           # ... and so much that a hot one is expected this often
MOST_HOT = 1 << 22         # minimisers that may be hot: with more text, more documents make a hot one
RUN_BYTES = 150            # text for each minimiser of a document, on average
FILTER_LOG = 26            # places of the filter of hot minimisers: at most 8 MB, whatever the input
MAX_ID = (1 << 63) - 1
_U = np.uint64
RANGES = "doc long, text_key long, start int, stop int"


class Hot:
    """The minimisers taken for hot: words of a bitmap over their last ``FILTER_LOG`` bits.  Words without
    a bit are not stored."""

    def __init__(self, index: np.ndarray, words: np.ndarray):
        order = np.argsort(index)
        self.index, self.words = index[order].astype(np.int64), words[order].view(_U)

    def __contains__(self, least: int) -> bool:
        return bool(self.test(np.array([least], _U))[0])

    def __len__(self) -> int:
        return len(self.index)

    def test(self, least: np.ndarray) -> np.ndarray:
        if not len(self.index):
            return np.zeros(len(least), bool)
        spot = least & _U((1 << FILTER_LOG) - 1)
        at = np.minimum(np.searchsorted(self.index, (spot >> _U(6)).astype(np.int64)), len(self.index) - 1)
        found = self.index[at] == (spot >> _U(6)).astype(np.int64)
        return found & ((self.words[at] >> (spot & _U(63))) & _U(1)).astype(bool)


NO_HOT = Hot(np.zeros(0, np.int64), np.zeros(0, np.int64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def super_kmers(w: Words, k: int = WINDOW, m: int = M) -> tuple[np.ndarray, ...]:
    """(first word, windows, row, minimiser, first window's hash, last window's hash) of every super-k-mer.
    A run is cut at ``k - m + 1`` windows, so its first and last window cover all of its words."""
    at, row = window_rows(w.first, k)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, _U))
    hashes = w.hashes()
    least = sliding_min(window_hashes(hashes, m), k - m + 1)[at]
    whole = window_hashes(hashes, k)[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % (k - m + 1) == 0)
    count = np.diff(np.append(begin, len(at)))
    return at[begin], count, row[begin], least[begin], whole[begin], whole[begin + count - 1]


def _pack(texts: list[bytes], meta: np.ndarray) -> bytes:
    sizes = np.array([len(t) for t in texts], dtype=np.int32)
    head = np.array([len(texts)], dtype=np.int32).tobytes()
    return zstandard.compress(head + sizes.tobytes() + np.ascontiguousarray(meta).tobytes() + b"".join(texts), 5)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    meta = np.frombuffer(data, np.int64, 4 * n, 4 + 4 * n).reshape(n, 4)
    return np.frombuffer(data, np.int32, n, 4), meta, data[4 + 36 * n:]


def _pack_windows(cols: np.ndarray) -> bytes:
    """Windows without text: rows of hash, second hash, id, text key, first word.  Their number is
    written negative, which tells them from ``_pack``."""
    return zstandard.compress(np.array([-cols.shape[1]], dtype=np.int32).tobytes() + np.ascontiguousarray(cols).tobytes(), 5)


def _unpack_windows(data: bytes) -> np.ndarray:
    n = -int(np.frombuffer(data, np.int32, 1)[0])
    return np.frombuffer(data, np.int64, 5 * n, 4).reshape(5, n)


def ranges_of(doc: np.ndarray, key: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Word ranges [start, stop) covered by windows, merged where they follow each other in order."""
    if not len(at):
        return [np.zeros(0, np.int64)] * 4
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] - at[:-1] > 1) | (at[1:] < at[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return [doc[begin], key[begin], at[begin], at[end] + k]


def deal_windows(w: Words, doc: np.ndarray, key: np.ndarray, at: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Windows of a slice that are dealt by their own hash (columns of ``_pack_windows``), and those
    already decided as runs (first word, windows, row).  Of equal windows the least document's stay, one
    for each text and place."""
    hashes = w.hashes()
    one, two = window_hashes(hashes, k)[at], window_hashes(hashes, k, seed=1)[at]
    place = at - w.first[row]
    order = np.lexsort((place, key[row], doc[row], two, one))
    a, b, d, t, p = one[order], two[order], doc[row][order], key[row][order], place[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lowest = d[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[1:] = ~head[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
    stay = (d == lowest) & ~again
    cols = np.stack([a.view(np.int64), b.view(np.int64), d, t, p])[:, stay]
    gone = np.sort(order[d > lowest])
    new = np.ones(len(gone), bool)
    new[1:] = (np.diff(at[gone]) != 1) | (np.diff(row[gone]) != 0)
    begin = np.flatnonzero(new)
    return cols, (at[gone[begin]], np.diff(np.append(begin, len(gone))), row[gone[begin]])


def _by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def pack_slice(doc: np.ndarray, key: np.ndarray, arr: pa.Array, buckets: int, k: int = WINDOW, hot: Hot = NO_HOT) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed super-k-mers) of a slice.  ``meta`` holds id, text key, first word, and windows;
    windows are negative for runs that are already decided (removed), which carry no text.  ``hot`` are
    the minimisers whose windows are dealt one by one."""
    w = Words(*buffers(arr))
    at, count, row, least, first, last = super_kmers(w, k)
    if not len(at):
        return
    often = hot.test(least)
    settled = tuple(np.zeros(0, np.int64) for _ in range(3))
    if often.any():
        n = count[often]
        each = np.repeat(at[often], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cols, settled = deal_windows(w, doc, key, each, np.repeat(row[often], n), k)
        bucket = (mix(cols[0].view(_U)) % _U(buckets)).astype(np.int64)
        for part in _by_bucket(bucket):
            yield int(bucket[part[0]]), _pack_windows(cols[:, part])
        at, count, row, least, first, last = (x[~often] for x in (at, count, row, least, first, last))
    same = mix(first) ^ mix(last + _U(1)) ^ mix(count.astype(_U))
    order = np.lexsort((doc[row], same))
    head = np.ones(len(order), bool)
    head[1:] = same[order][1:] != same[order][:-1]
    lowest = doc[row][order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    decided = np.zeros(len(order), bool)
    decided[order] = doc[row][order] > lowest
    at, count, row = (np.concatenate([x, y]) for x, y in zip((at, count, row), settled))
    least = np.concatenate([least, np.zeros(len(settled[0]), _U)])
    decided = np.concatenate([decided, np.ones(len(settled[0]), bool)])
    bucket = (mix(np.where(decided, doc[row].astype(_U), least)) % _U(buckets)).astype(np.int64)
    meta = np.stack([doc[row], key[row], at - w.first[row], np.where(decided, -count, count)], axis=1)
    begin, end = w.starts[at], w.ends[at + count + k - 2]
    end = np.where(decided, begin, end)
    raw = w.raw.tobytes()
    for part in _by_bucket(bucket):
        yield int(bucket[part[0]]), _pack([raw[b:e] for b, e in zip(begin[part].tolist(), end[part].tolist())], meta[part])


def count_bucket(blobs: list[bytes], k: int = WINDOW) -> list[np.ndarray]:
    """Ranges to remove among a bucket's super-k-mers and single windows: windows are sorted by hash
    (128 bits) and every window of a larger document than the group's least is removed."""
    datas = [zstandard.decompress(b) for b in blobs]
    runs = [_unpack(d) for d in datas if np.frombuffer(d, np.int32, 1)[0] >= 0]
    alone = [_unpack_windows(d) for d in datas if np.frombuffer(d, np.int32, 1)[0] < 0]
    sizes, metas, texts = zip(*runs or [(np.zeros(0, np.int32), np.zeros((0, 4), np.int64), b"")])
    size, meta = np.concatenate(sizes), np.concatenate(metas)
    single = np.concatenate([np.zeros((5, 0), np.int64), *alone], axis=1)
    w = Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
    decided = meta[:, 3] < 0
    n_windows = np.abs(meta[:, 3])
    run = np.repeat(np.arange(len(meta)), n_windows)
    place = meta[run, 2] + np.arange(len(run)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at, _ = window_rows(w.first, k)        # the windows of the runs that are open, in the same order
    hashes = w.hashes()
    one, two = (np.concatenate([window_hashes(hashes, k, seed=i)[at], single[i].view(_U)]) for i in (0, 1))
    doc, key, place = (np.concatenate([x, y]) for x, y in zip((meta[run, 0], meta[run, 1], place), single[2:]))
    gone = np.concatenate([decided[run], np.zeros(single.shape[1], bool)])
    open_ = np.flatnonzero(~gone)
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if len(a) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(head)
    ids = doc[open_][order]
    least = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.append(begin, len(ids)))) if len(ids) else ids
    gone[open_[order[ids > least]]] = True
    hit = np.flatnonzero(gone)
    return ranges_of(doc[hit], key[hit], place[hit], k)


def hot_runs(total: int) -> int:
    """How many documents make a minimiser hot: so many that ``total`` bytes have ``MOST_HOT`` such at most."""
    return max(HOT_RUNS, total // (RUN_BYTES * MOST_HOT))


def hot_minimisers(narrow: DataFrame, total: int, k: int = WINDOW) -> Hot:
    """Minimisers that about ``hot_runs`` rows or more hold, counted in a sample of rows.  What comes to the
    driver are words of the filter: 16 MB at most."""
    runs = hot_runs(total)
    share = min(1.0, max(SAMPLE_BYTES / max(total, 1), SAMPLE_HITS / runs))
    few = narrow.select("text")
    if share < 1.0:
        few = few.sample(False, share, seed=k)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, row, least, _, _ = super_kmers(Words(*buffers(part.column("text"))), k)
                order = np.lexsort((row, least))
                row, least = row[order], least[order]
                new = np.ones(len(order), bool)
                new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
                found, n = np.unique(least[new], return_counts=True)
                yield pa.RecordBatch.from_pydict({"least": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    spot = F.col("least").bitwiseAND(F.lit((1 << FILTER_LOG) - 1))
    words = (few.mapInArrow(held, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= F.lit(runs * share)).select(F.shiftright(spot, 6).alias("index"), spot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("index").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word")).toArrow())
    return Hot(words.column("index").to_numpy(), words.column("word").to_numpy())


def _row_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID))


def packed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """(bucket, blob): all windows, as ``pack_slice`` packs them."""
    narrow = docs.select(_row_key(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    narrow = narrow.withColumn("text_key", F.xxhash64("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(total * EXPANSION / BUCKET_BYTES))
    hot = hot_minimisers(narrow, total, k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(pack_slice(part.column("doc").to_numpy(zero_copy_only=False), part.column("text_key").to_numpy(zero_copy_only=False),
                                       part.column("text"), buckets, k, hot))
                if rows:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()),
                                                      "blob": pa.array([r[1] for r in rows], pa.binary())})

    return narrow.select("doc", "text_key", "text").mapInArrow(pack, "bucket long, blob binary")


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """(doc, text_key, start, stop): word ranges to remove; ranges of one document may overlap."""
    def count(group: pa.Table) -> pa.Table:
        doc, key, start, stop = count_bucket(group.column("blob").to_pylist(), k)
        return pa.table({"doc": doc.astype(np.int64), "text_key": key.astype(np.int64), "start": start.astype(np.int32),
                         "stop": stop.astype(np.int32)})

    return packed_windows(docs, id_col, text_col, k).groupBy("bucket").applyInArrow(count, RANGES)


def _kept(words: list[bytes], ranges: list[dict] | None) -> tuple[list[bytes], int]:
    """The words outside all ranges, and how many were inside."""
    if not ranges:
        return words, 0
    out, at = [], 0
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    out += words[at:]
    return out, len(words) - len(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and, on request, the kept text of every row."""
    ranges = (removed_ranges(docs, id_col, text_col, k).groupBy("doc", "text_key")
              .agg(F.collect_list(F.struct("start", "stop")).alias("ranges")))
    narrow = docs.select(F.col(id_col).alias("id"), _row_key(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    joined = narrow.withColumn("text_key", F.xxhash64("text")).join(ranges, ["doc", "text_key"], "left").select("id", "text", "ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [_kept(t.encode().split(), r) for t, r in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist())]
                texts = [b" ".join(words) for words, _ in kept]
                cols = [part.column("id"), pa.array([len(words) + n for words, n in kept], pa.int64()), pa.array([n for _, n in kept], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    cols.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept_sha256", "kept"][:len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(finish, f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
