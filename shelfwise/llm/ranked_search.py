"""Operator 11, ranked lexical search: Block-Max MaxScore over shards of documents.

A slice of a task's documents is a shard.  The index is a written table with one row per shard and term:
its postings (document, occurrences) in compressed blocks of ``BLOCK``, and a head per block with what
bounds any score in it, the least document length for one, two, three and more occurrences.  A row
without term holds the shard's document ids and lengths.  Nothing of the index is shuffled but the
postings of the terms that are asked for.

Global figures (documents, terms, document frequencies and each term's highest possible score) come from
sums and extremes over the index.  Inside a shard, an item's lists are taken in descending order of those
global bounds: lists are essential as long as a document that is only in the rest could still be among
the best; the rest only completes documents already found, and a block whose maximum cannot lift a
document to the threshold is rejected before it is decompressed.  The threshold is the k-th best score
so far, carried from shard to shard of a task, so later shards prune more.  A task emits at most ``k``
documents an item; these heaps are merged by a window.

Items are dealt to blocks of about ``ITEMS`` by hash, and a shard meets every block of items that holds
one of its terms, so neither the number of items nor of documents gathers in one task.  ``build`` takes a
filter of fixed size over the terms that will be asked for (none: all terms).

Terms are compared by a 64-bit hash: two different ones are taken for equal with that probability.
Null and empty texts have no terms; null items' texts likewise, and an item without an id gets no rows.
Rows that share an item id are one item with the terms of all.  Rows that share a document id are
documents of their own, ranked one after the other; a null document id ranks as the largest.  Empty
tables give no rows.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import buffers, byte_hashes, slices, text_or_empty, written

K = 50
BLOCK = 128                # postings of a compressed block
SHARD_BYTES = 8 << 20      # text of a shard
SHARDS_A_TASK = 16         # shards that a search task walks, where there are enough for all cores
ITEMS = 256                # items that a block of queries holds on average
FILTER_BITS = 1 << 22      # of the filter over the terms asked for: its size, however many they are
MAX_ID = (1 << 63) - 1
INDEX = ("shard long, term long, n_docs long, n_terms long, low1 long, low2 long, low3 long, low4 long, top long, "
         "heads binary, data binary")
NEVER = (1 << 32) - 1      # length that stands for "no document with so many occurrences"
HEAD = np.dtype([("last", "<u4"), ("size", "<u4"), ("count", "<u2"), ("gap_width", "u1"), ("tf_width", "u1"), ("low", "<u4", 4), ("top", "<u4")])
_IN_TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IN_TERM[_a:_b] = True
_U = np.uint64


def term_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of every text, in order, and ``first[d]:first[d + 1]`` as the terms of row d."""
    raw, offs = buffers(arr)
    raw = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
    solid = _IN_TERM[raw]
    n = len(raw)
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    before[offs] = False                   # a row's first byte follows nothing
    starts = np.flatnonzero(solid & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    after[offs] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return byte_hashes(raw, starts, ends), np.searchsorted(starts, offs)


# ---------------------------------------------------------------- index

def _spots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h % _U(FILTER_BITS), (h >> _U(32)) % _U(FILTER_BITS)


def term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of ``FILTER_BITS`` bits over column ``term``.  It is put together from words of 64
    bits by an aggregate, so the driver gets at most FILTER_BITS / 64 rows."""
    spot = F.explode(F.array(F.pmod("term", F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned("term", 32), F.lit(FILTER_BITS))))
    words = (terms.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS int))")).alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _starts_to_sizes(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def _little(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Write every value at its place in ``out`` with its width in bytes, lowest byte first."""
    for b in range(int(width.max(initial=0))):
        wide = width > b
        out[at[wide] + b] = (values[wide] >> (8 * b)) & 255


def pack_shard(ids: np.ndarray, arr: pa.Array, shard: int, wanted: np.ndarray | None) -> pa.RecordBatch:
    """The index rows of one shard."""
    hashes, first = term_hashes(arr)
    length = np.diff(first)
    doc = np.repeat(np.arange(len(length)), length)
    if wanted is not None:
        one, two = _spots(hashes)
        hit = wanted[one] & wanted[two]
        hashes, doc = hashes[hit], doc[hit]
    terms, which = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(which.astype(np.int64) * max(len(length), 1) + doc, return_counts=True)
    which, doc = np.divmod(pair, max(len(length), 1))
    lists = np.flatnonzero(np.diff(which, prepend=-1))
    list_size = _starts_to_sizes(lists, len(doc))
    place = np.arange(len(doc)) - np.repeat(lists, list_size)
    blocks = np.flatnonzero(place % BLOCK == 0)
    heads = np.zeros(len(blocks), HEAD)
    body = np.zeros(0, np.uint8)
    if len(blocks):
        count = _starts_to_sizes(blocks, len(doc))
        gap = np.diff(doc, prepend=0)
        gap[lists] = doc[lists] + 1        # gaps run on from block to block of a list; the first is from -1
        gap_width = np.where(np.maximum.reduceat(gap, blocks) < 256, 1, np.where(np.maximum.reduceat(gap, blocks) < 65536, 2, 4))
        top = np.maximum.reduceat(tf, blocks)
        tf_width = np.where(top < 256, 1, np.where(top < 65536, 2, 4))
        size = count * (gap_width + tf_width)
        begin = np.cumsum(size) - size
        body = np.zeros(int(size.sum()), np.uint8)
        inside = np.arange(len(doc)) - np.repeat(blocks, count)
        gw, tw = np.repeat(gap_width, count), np.repeat(tf_width, count)
        _little(gap, np.repeat(begin, count) + inside * gw, gw, body)
        _little(tf, np.repeat(begin + count * gap_width, count) + inside * tw, tw, body)
        heads["last"], heads["size"], heads["count"], heads["top"] = doc[np.append(blocks[1:], len(doc)) - 1], size, count, top
        heads["gap_width"], heads["tf_width"] = gap_width, tf_width
        n = np.minimum(length[doc], NEVER - 1)
        for k in range(4):
            heads["low"][:, k] = np.minimum.reduceat(np.where(tf == k + 1 if k < 3 else tf > 3, n, NEVER), blocks)
    of_list = np.searchsorted(blocks, lists)                 # a list's first block
    ends = np.append(np.cumsum(heads["size"], dtype=np.int64), 0)
    data_offs = np.concatenate([[0], ends[np.append(of_list[1:], len(blocks)) - 1]]) if len(lists) else np.zeros(1, np.int64)
    head_offs = np.append(of_list, len(blocks)) * HEAD.itemsize

    def least(k: int) -> np.ndarray:
        return np.minimum.reduceat(heads["low"][:, k], of_list).astype(np.int64) if len(lists) else np.zeros(0, np.int64)

    def binary(offs: np.ndarray, raw: bytes) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    none = np.zeros(1, np.int64)
    highest = np.maximum.reduceat(heads["top"], of_list).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    columns = {
        "shard": pa.array(np.full(len(lists) + 1, shard, np.int64)),
        "term": pa.concat_arrays([pa.array([None], pa.int64()), pa.array(terms.view(np.int64))]),
        "n_docs": pa.array(np.concatenate([[int((length > 0).sum())], list_size]).astype(np.int64)),
        "n_terms": pa.array(np.concatenate([[int(length.sum())], np.zeros(len(lists), np.int64)]).astype(np.int64)),
        **{f"low{k + 1}": pa.array(np.concatenate([none, least(k)])) for k in range(4)},
        "top": pa.array(np.concatenate([none, highest])),
        "heads": pa.concat_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), binary(head_offs, heads.tobytes())]),
        "data": pa.concat_arrays([pa.array([length.astype(np.int64).tobytes()], pa.binary()), binary(data_offs, body.tobytes())])}
    return pa.RecordBatch.from_pydict(columns)


def build(docs: DataFrame, wanted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs``, written below the shared folder.  ``wanted`` (``term_filter``) keeps the
    postings of those terms only; lengths always count all terms."""
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("id"), text_or_empty(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                held.append(part)
                size += part.nbytes
                if size >= shard_bytes or sum(p.num_rows for p in held) >= 1 << 16:
                    yield _shard_of(held, shard, wanted)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield _shard_of(held, shard, wanted)

    return written(narrow.mapInArrow(pack, INDEX), "search-index")


def _shard_of(parts: list[pa.RecordBatch], shard: int, wanted: np.ndarray | None) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts)
    text = whole.column("text").cast(pa.large_string()).combine_chunks()
    return pack_shard(whole.column("id").to_numpy(), text, shard, wanted)


# ---------------------------------------------------------------- scores

def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share of a document's score but for the term's weight (64-bit integers, rounded down)."""
    m = 50 + (50 * length * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def head_bounds(heads: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The highest impact that a posting of each block can have."""
    out = np.zeros(len(heads), np.int64)
    for k in range(4):
        low = heads["low"][:, k].astype(np.int64)
        tf = heads["top"].astype(np.int64) if k == 3 else np.full(len(heads), k + 1, np.int64)
        out = np.maximum(out, np.where(low < NEVER, impact(tf, low, n_docs, n_terms), 0))
    return out


class Postings:
    """One term's list in a shard; blocks are decompressed when a score in them is needed."""

    def __init__(self, weight: int, heads: bytes, data: bytes, lengths: np.ndarray, stats: tuple[int, int]):
        self.heads = np.frombuffer(heads, HEAD)
        self.data, self.weight, self.lengths, self.stats = data, weight, lengths, stats
        self.last = self.heads["last"].astype(np.int64)
        self.bounds = weight * head_bounds(self.heads, *stats)
        self.begin = np.concatenate([[0], np.cumsum(self.heads["size"], dtype=np.int64)])
        self.open: list = [None] * len(self.heads)
        self.whole: tuple | None = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of a block."""
        if self.open[b] is None:
            h, at = self.heads[b], int(self.begin[b])
            n, gw, tw = int(h["count"]), int(h["gap_width"]), int(h["tf_width"])
            gaps = np.frombuffer(self.data, f"<u{gw}", n, at).astype(np.int64)
            tf = np.frombuffer(self.data, f"<u{tw}", n, at + n * gw).astype(np.int64)
            docs = (int(self.last[b - 1]) if b else -1) + np.cumsum(gaps)
            self.open[b] = docs, self.weight * impact(tf, self.lengths[docs], *self.stats)
        return self.open[b]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            parts = [self.block(b) for b in range(len(self.heads))]
            self.whole = tuple(np.concatenate(x) for x in zip(*parts))
        return self.whole

    def add_to(self, found: np.ndarray, total: np.ndarray, rest: int, threshold: int) -> np.ndarray:
        """Complete the totals of the documents ``found`` with this list; those that cannot reach the
        threshold with the block's maximum and ``rest`` leave, without their block being opened."""
        b = np.searchsorted(self.last, found)
        inside = b < len(self.last)
        most = np.where(inside, self.bounds[np.minimum(b, len(self.last) - 1)], 0)
        stay = total[found] + most + rest >= threshold
        found, b = found[stay], b[stay]
        need = np.unique(b[b < len(self.last)])
        if len(need):
            parts = [self.block(int(x)) for x in need] if self.whole is None else [self.whole]
            docs, scores = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            hit = docs[at] == found
            total[found[hit]] += scores[at[hit]]
        return found


def best_of_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, so_far: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best among ``so_far`` and the shard's documents; equal scores by id.
    ``lists`` are an item's lists with their global bounds."""
    lists = sorted(lists, key=lambda x: -x[0])
    rest = np.cumsum([b for b, _ in lists][::-1])[::-1].tolist() + [0]
    threshold = max(int(so_far[0][-1]) if len(so_far[0]) >= k else 1, 1)
    total = np.zeros(len(ids), np.int64)
    at = 0
    while at < len(lists) and rest[at] >= threshold:         # essential: they find documents
        docs, scores = lists[at][1].all()
        total[docs] += scores
        at += 1
        if len(ids) > k and at < len(lists):
            threshold = max(threshold, int(np.partition(total, len(ids) - k)[len(ids) - k]))
    found = np.flatnonzero(total)
    for j in range(at, len(lists)):                          # non-essential: they complete documents
        found = lists[j][1].add_to(found[total[found] + rest[j] >= threshold], total, rest[j + 1], threshold)
    found = found[total[found] >= threshold]
    if not len(found):
        return so_far
    score, doc = np.concatenate([so_far[0], total[found]]), np.concatenate([so_far[1], ids[found]])
    order = np.lexsort((doc, -score))[:k]
    return score[order], doc[order]


def _search_task(stats: tuple[int, int], k: int):
    """A task's part of the search: rows sorted by (block of items, shard, term; null first)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        heaps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now, ids, lengths = None, None, None
        lists: dict[int, list] = {}

        def close() -> None:
            for item, its in lists.items():
                heaps[item] = best_of_shard(its, ids, heaps.get(item, nothing), k)
            lists.clear()

        def emit() -> pa.RecordBatch:
            size = [len(s) for s, _ in heaps.values()]
            cols = [np.repeat(np.fromiter(heaps, np.int64, len(heaps)), size)]
            cols += [np.concatenate([h[i] for h in heaps.values()]) if heaps else nothing[0] for i in (1, 0)]
            heaps.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "doc_id", "score"])

        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)) for c in ("block", "shard", "term", "weight", "bound", "items", "heads", "data")]
            for block, shard, term, weight, bound, items, heads, data in zip(*[c.to_pylist() for c in rows]):
                if (block, shard) != now:
                    close()
                    if now is not None and block != now[0]:
                        yield emit()
                    now = (block, shard)
                if term is None:
                    ids, lengths = np.frombuffer(heads, np.int64), np.frombuffer(data, np.int64)
                else:
                    one = Postings(weight, heads, data, lengths, stats)
                    for item in items:
                        lists.setdefault(item, []).append((bound, one))
        close()
        yield emit()

    return search


# ---------------------------------------------------------------- queries

def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of every item, as hashes."""
    narrow = items.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text")).where("item_id IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = term_hashes(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_pydict({"item_id": part.column("item_id").take(pa.array(row)), "term": pa.array(hashes.view(np.int64))})

    return narrow.mapInArrow(cut, "item_id long, term long").distinct()


def term_stats(index: DataFrame, terms: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, n_docs, weight, bound) of the terms asked for that any document holds."""
    of = index.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.sum("n_docs").alias("n_docs"), *[F.min(f"low{k}").alias(f"low{k}") for k in (1, 2, 3, 4)], F.max("top").alias("top"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2)) / (2 * F.col("n_docs") + 1))).cast("long")

    def most(low: str, tf: str) -> str:
        m = f"(50 + (50 * {low} * {n_docs}) div {max(n_terms, 1)})"
        return f"if({low} < {NEVER}, (1000000000L * {tf}) div (1000 * {tf} + 20 * {m}), 0L)"
    highest = F.expr(f"greatest({most('low1', '1')}, {most('low2', '2')}, {most('low3', '3')}, {most('low4', 'top')})")
    return of.select("term", "n_docs", weight.alias("weight"), (weight * highest).alias("bound"))


def search(index: DataFrame, terms: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item.  ``terms`` as from ``item_terms``."""
    shards = index.where("term IS NULL")
    n_docs, n_terms, n_shards = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-n_shards // SHARDS_A_TASK), min(n_shards, index.sparkSession.sparkContext.defaultParallelism))
    blocks = max(1, -(-terms.select("item_id").distinct().count() // ITEMS))
    stats = term_stats(index, terms, n_docs, n_terms)
    asked = terms.join(stats, "term").where("weight > 0").groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(
        F.first("weight").alias("weight"), F.first("bound").alias("bound"), F.collect_list("item_id").alias("items"))
    asked = written(asked, "search-terms")
    order = ["block", "shard", "term", "weight", "bound", "items", "heads", "data"]
    lists = index.where("term IS NOT NULL").select("shard", "term", "heads", "data").join(asked, "term").select(*order)
    shards = shards.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "shard", "term", F.lit(0).cast("long").alias("weight"),
        F.lit(0).cast("long").alias("bound"), F.array().cast("array<long>").alias("items"), "heads", "data")
    rows = lists.unionByName(shards).repartition(tasks, "shard").sortWithinPartitions("block", "shard", F.asc_nulls_first("term"))
    heaps = rows.mapInArrow(_search_task((n_docs, n_terms), k), "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    out = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("item_id", "rank", F.expr(f"nullif(doc_id, {MAX_ID})").alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index the documents for the items' terms, and search."""
    terms = written(item_terms(items), "item-terms")
    return search(build(docs, term_filter(terms)), terms, k)
