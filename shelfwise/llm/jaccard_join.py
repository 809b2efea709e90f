"""Operator 1, n-gram Jaccard join: a prefix-tree join of globally ordered shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, 56-bit hashes); two documents
link when 100 * intersection >= 75 * union.  Null, empty and blank texts have an empty set and link
with nothing.  Equal sets are one class from then on; rows that share an id are judged by their own
texts.  A null id is no document's smallest.  Only id and text are read, and ``one_of_each`` keeps the
other columns, whatever their names; an empty table gives an empty result.

1. Document frequencies.  Every slice of a task sends its sorted shingles, packed, to buckets of the
   hash range; buckets send back those that a second document holds.  Shingles common inside a slice
   send a count and no document list, so a passage in a third of all documents stays small.
   A document with fewer shared shingles than the threshold needs can link with nothing.
2. The global order is (frequency class, hash).  A class posts the first shared shingles of its set,
   enough that two linked classes share a posting.
3. Rounds: classes that share a posting with another component meet in groups of bounded size, where
   a trie over their whole sets finds links.  Paths that sets share are counted once; a subtree is
   left when the elements that remain cannot reach the threshold, or when all of it is already in
   the probe's component.  The links are contracted to components.
4. The rest, exactly: postings that still join different components are dealt by token and band of
   set size, so that pairs which length or position exclude do not meet; pairs that pass both bounds
   are checked on the whole sets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Words, buffers, mix, release, slices, text_or_empty, unused, window_hashes, window_rows, written
from shelfwise.llm.components import components

SHINGLE = 5
PERCENT = 75
HOT = 64                   # documents of one slice from which a shingle sends only its count
BUCKET_SHINGLES = 1_000_000
GROUP_SETS = 256           # sets that meet in one trie
GROUP_TOKENS = 400_000     # and about as many of their shingles
ROUNDS = 2
MAX_ID = (1 << 63) - 1
_U = np.uint64
_HASH_BITS = _U(56)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes, 5), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, data in pickle.loads(zstandard.decompress(blob)):
        dtype = np.dtype(kind)
        planes = np.frombuffer(data, np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def need(a, b):
    """Least intersection of linked sets with ``a`` and ``b`` elements."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n):
    """How many first elements (in the global order) two linked sets cannot both miss."""
    return n + (-PERCENT * n // 100) + 1


def shingle_sets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of every distinct shingle, ordered by row and hash; set sizes; class ids."""
    w = Words(raw, offs, lower=True)
    hashes = w.hashes()
    at, row = window_rows(w.first, SHINGLE)
    shingle = window_hashes(hashes, SHINGLE)[at]
    for d in np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < SHINGLE)):   # short texts: one element
        own = hashes[w.first[d]:w.first[d + 1]]
        shingle = np.append(shingle, window_hashes(own, len(own), seed=len(own)))
        row = np.append(row, d)
    shingle = shingle >> (_U(64) - _HASH_BITS)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    shingle, row = shingle[keep], row[keep]
    size = np.bincount(row, minlength=len(offs) - 1)
    total = np.concatenate([[_U(0)], np.cumsum(mix(shingle + _U(0x51ED270B)), dtype=_U)])
    first = np.concatenate([[0], np.cumsum(size)])
    key = mix(total[first[1:]] - total[first[:-1]] + mix(size.astype(_U)))
    return shingle, row, size, key.view(np.int64)


def _send(part: pa.RecordBatch, slice_id: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """(bucket, slice, blob) rows of a slice: one that holds its documents and its common shingles,
    and one for every bucket with the others."""
    shingle, row, size, key = shingle_sets(*buffers(part.column("text")))
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order].astype(np.uint16)
    head = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, int)
    count = np.diff(np.append(head, len(shingle)))
    hot = count > HOT
    by_entry = np.repeat(hot, count)
    own = pack(part.column("doc").to_numpy(zero_copy_only=False), part.column("text_key").to_numpy(zero_copy_only=False), size, key,
               shingle[head[hot]], count[hot], row[by_entry])
    out = [(slice_id % buckets, slice_id, own)]
    value, listed = shingle[head], np.where(hot, 0, count)
    bucket = ((value >> _U(24)) * _U(buckets) >> (_HASH_BITS - _U(24))).astype(np.int64)
    refs = row[~by_entry]
    ends = np.cumsum(listed)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part_ in np.split(np.arange(len(value)), cuts) if len(value) else []:
        a, b = part_[0], part_[-1] + 1
        out.append((int(bucket[a]), -1 - slice_id, pack(steps(value[a:b]), count[a:b].astype(np.uint32), hot[a:b],
                                                        refs[ends[a] - listed[a]:ends[b - 1]])))
    return out


def _reply(group: pa.Table) -> pa.Table:
    """A bucket: frequencies over all slices; each slice gets back what is not its own alone."""
    slice_ids, blobs = group.column("slice").to_pylist(), group.column("blob").to_pylist()
    out = [(s, b) for s, b in zip(slice_ids, blobs) if s >= 0]            # documents pass through
    sent = [(-1 - s, unpack(b)) for s, b in zip(slice_ids, blobs) if s < 0]
    if sent:
        values = [np.cumsum(x[0], dtype=_U) for _, x in sent]
        every, place = np.unique(np.concatenate(values), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([x[1] for _, x in sent]), minlength=len(every)).astype(np.int64)
        at = 0
        for (s, (_, own, hot, refs)), value in zip(sent, values):
            df = count[place[at:at + len(value)]]
            at += len(value)
            shared = df > 1
            if shared.any():
                listed = np.where(hot, 0, own)
                out.append((-1 - s, pack(steps(value[shared]), df[shared].astype(np.uint32), listed[shared].astype(np.uint16),
                                         refs[np.repeat(shared, listed)])))
    return pa.table({"slice": pa.array([s if s >= 0 else -1 - s for s, _ in out], pa.int64()),
                     "own": pa.array([s >= 0 for s, _ in out], pa.bool_()), "blob": pa.array([b for _, b in out], pa.binary())})


def frequency_class(df: np.ndarray) -> np.ndarray:
    """0 to 255, monotone: exact to 63, then eight steps for each doubling."""
    return np.where(df < 64, df, np.minimum(64 + (8 * np.log2(np.maximum(df, 1) / 64)).astype(np.int64), 255)).astype(_U)


def _sets_of(group: pa.Table) -> pa.Table:
    """A slice again: its documents, with the ordered shared elements of those that may link."""
    own = group.column("own").to_pylist()
    blobs = group.column("blob").to_pylist()
    doc, text_key, size, key, hot_value, hot_count, hot_row = unpack(next(b for o, b in zip(own, blobs) if o))
    tokens, rows = [], []
    hot_first = np.concatenate([[0], np.cumsum(hot_count)])
    for blob in (b for o, b in zip(own, blobs) if not o):
        step, df, listed, refs = unpack(blob)
        value = np.cumsum(step, dtype=_U)
        token = (frequency_class(df.astype(np.int64)) << _HASH_BITS) | value
        tokens.append(np.repeat(token, listed))
        rows.append(refs)
        for i in np.flatnonzero(listed == 0):
            h = np.searchsorted(hot_value, value[i])
            mine = hot_row[hot_first[h]:hot_first[h + 1]]
            tokens.append(np.full(len(mine), token[i], _U))
            rows.append(mine)
    token = np.concatenate(tokens) if tokens else np.zeros(0, _U)
    row = np.concatenate(rows) if rows else np.zeros(0, np.uint16)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    shared = np.bincount(row, minlength=len(doc))
    first = np.concatenate([[0], np.cumsum(shared)])
    may = (size > 0) & (100 * shared >= PERCENT * size)
    return pa.table({"doc": pa.array(doc), "text_key": pa.array(text_key), "n": pa.array(size.astype(np.int64)), "cid": pa.array(key),
                     "tokens": pa.array([token[first[d]:first[d + 1]].tobytes() if may[d] else None for d in range(len(doc))], pa.binary())})


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_key, n, cid, tokens): set size and class of every row; ``tokens`` (ordered 64-bit
    values) only where a link is possible."""
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("doc"), text_or_empty(text_col).alias("text"))
    narrow = narrow.withColumn("text_key", F.xxhash64("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(total / 6 / BUCKET_SHINGLES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                rows = _send(part, slice_id, buckets)
                slice_id += 1
                for a in range(0, len(rows), 256):
                    some = rows[a:a + 256]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in some], pa.int64()),
                                                      "slice": pa.array([r[1] for r in some], pa.int64()),
                                                      "blob": pa.array([r[2] for r in some], pa.binary())})
                del rows
                release()

    def reply(group: pa.Table) -> pa.Table:
        out = _reply(group)
        release()
        return out

    def sets_of(group: pa.Table) -> pa.Table:
        out = _sets_of(group)
        release()
        return out

    sent = narrow.select("doc", "text_key", "text").mapInArrow(send, "bucket long, slice long, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(reply, "slice long, own boolean, blob binary")
    sets = replies.groupBy("slice").applyInArrow(sets_of, "doc long, text_key long, n long, cid long, tokens binary")
    return written(sets, "shingle-sets")


class Trie:
    """A radix trie of ordered sets with a union-find over them.

    Elements are ranks inside the group, most frequent first, so near copies share long paths."""

    def __init__(self, sizes: np.ndarray, labels: list, n_ranks: int):
        self.sizes = sizes
        self.up = list(range(len(sizes)))
        self.links: list[tuple[int, int]] = []
        seen: dict = {}
        for i, label in enumerate(labels):
            self.up[i] = seen.setdefault(label, i)
        self.mark = np.zeros(n_ranks, bool)
        self.root = {"seg": np.zeros(0, np.int64), "kids": {}, "ends": [], "low": 1 << 60, "rest": 0, "one": None}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def _note(self, node: dict, i: int, rest: int) -> None:
        node["low"] = min(node["low"], int(self.sizes[i]))
        node["rest"] = max(node["rest"], rest)
        if node["one"] is None:
            node["one"] = i
        elif node["one"] >= 0 and self.find(node["one"]) != self.find(i):
            node["one"] = -1

    def insert(self, i: int, ranks: np.ndarray) -> None:
        node, at = self.root, 0
        self._note(node, i, len(ranks))
        while at < len(ranks):
            kid = node["kids"].get(int(ranks[at]))
            if kid is None:
                kid = {"seg": ranks[at:], "kids": {}, "ends": [i], "low": 1 << 60, "rest": 0, "one": None}
                node["kids"][int(ranks[at])] = kid
                self._note(kid, i, 0)
                return
            seg = kid["seg"]
            k = min(len(seg), len(ranks) - at)
            differ = np.flatnonzero(seg[:k] != ranks[at:at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(seg):            # split the segment
                tail = dict(kid, seg=seg[same:])
                kid.update(seg=seg[:same], kids={int(seg[same]): tail}, ends=[], rest=kid["rest"] + len(seg) - same)
            at += same
            self._note(kid, i, len(ranks) - at)
            node = kid
        node["ends"].append(i)

    def probe(self, i: int, ranks: np.ndarray) -> None:
        """Link set ``i`` with one set at least of every component that it links with."""
        self.mark[ranks] = True
        size = int(self.sizes[i])
        stack = [(self.root, 0, len(ranks))]
        while stack:
            node, have, left = stack.pop()
            if node["one"] is not None and node["one"] >= 0 and self.find(node["one"]) == self.find(i):
                continue
            seg = node["seg"]
            if len(seg):
                have += int(np.count_nonzero(self.mark[seg]))
                left = len(ranks) - int(np.searchsorted(ranks, seg[-1], side="right"))
            if have + min(left, node["rest"]) < need(size, node["low"]):
                continue
            for j in node["ends"]:
                if have >= need(size, int(self.sizes[j])) and self.find(i) != self.find(j):
                    self.links.append((i, j))
                    self.up[self.find(i)] = self.find(j)
            for kid in node["kids"].values():
                stack.append((kid, have, left))
        self.mark[ranks] = False


def trie_links(sizes: np.ndarray, labels: list, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all components of a group of sets (positions of the sets)."""
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, _U)
    trie = Trie(sizes, labels, len(every))
    for i in np.argsort(sizes, kind="stable").tolist():
        ranks = np.sort(len(every) - 1 - np.searchsorted(every, sets[i]))
        trie.probe(i, ranks)
        trie.insert(i, ranks)
    return trie.links


def _join_group(group: pa.Table) -> pa.Table:
    labels = group.column("label").to_pylist()
    sets = [np.frombuffer(b, _U) for b in group.column("tokens").to_pylist()]
    links = trie_links(group.column("n").to_numpy(), labels, sets)
    return pa.table({"a": pa.array([labels[i] for i, _ in links], pa.int64()), "b": pa.array([labels[j] for _, j in links], pa.int64())})


def _postings(classes: DataFrame) -> DataFrame:
    """(token, cid, n, rest): the shared part of every prefix; ``rest`` elements follow in the set."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                n = part.column("n").to_numpy()
                sets = [np.frombuffer(b, np.int64) for b in part.column("tokens").to_pylist()]
                take = [prefix_length(int(k)) - (int(k) - len(s)) for k, s in zip(n, sets)]
                rest = [len(s) - 1 - np.arange(t) for s, t in zip(sets, take)]
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate([s[:t] for s, t in zip(sets, take)])),
                    "cid": pa.array(np.repeat(part.column("cid").to_numpy(), take)), "n": pa.array(np.repeat(n, take)),
                    "rest": pa.array(np.concatenate(rest).astype(np.int64))})

    posts = classes.select("cid", "n", "tokens").mapInArrow(post, "token long, cid long, n long, rest long")
    many = posts.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a != b").select("token")
    return written(posts.join(many, "token"), "postings")


def _labelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of tokens that still stand in more than one component."""
    now = posts.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = now.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("token")
    return now.join(mixed, "token")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between components; (cid, label) where the label is not the class itself."""
    roots = components(links)
    moved = labels.join(roots, labels["label"] == roots["node"], "left").select("cid", F.coalesce("root", "label").alias("label"))
    new = roots.select(F.col("node").alias("cid"), F.col("root").alias("label")).join(labels.select("cid"), "cid", "left_anti")
    return written(moved.union(new), "labels")


def _round(posts: DataFrame, classes: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Links of the classes that meet under one of their postings, drawn by ``seed``."""
    now = _labelled(posts, labels)
    drawn = now.groupBy("cid", "label").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "token").alias("h"), "token", "n")).alias("d"))
    drawn = drawn.select("cid", "label", F.col("d.token").alias("token"), F.col("d.n").alias("n"))
    load = F.greatest(F.count(F.lit(1)) / GROUP_SETS, F.sum("n") / GROUP_TOKENS)
    parts = drawn.groupBy("token").agg(F.ceil(load).alias("parts"), F.min("label").alias("a"), F.max("label").alias("b"))
    met = (drawn.join(parts.where("a != b"), "token")
           .select("cid", "label", "token", F.pmod(F.xxhash64(F.lit(seed), "cid"), "parts").alias("part")))
    groups = met.join(classes, "cid").select("token", "part", "label", "n", "tokens")
    return groups.groupBy("token", "part").applyInArrow(_join_group, "a long, b long")


def size_band(n: Column) -> Column:
    """Monotone: exact to 15, then four steps for each doubling."""
    return F.when(n < 16, n).otherwise(16 + F.floor(4 * F.log2(n / 16))).cast("long")


def _dealt(posts: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Postings as the larger and as the smaller set of a pair, by token and band of the smaller's size.
    The larger one looks in the bands of the sizes that its own bounds allow; a set whose position rules
    out sets as large as itself is no smaller one."""
    most = F.expr(f"{100 + PERCENT} * (1 + rest) div {PERCENT}") - F.col("n")       # largest partner by position
    low, high = F.expr(f"({PERCENT} * n + 99) div 100"), F.least("n", most)
    cols = ["token", "cid", "n", "rest", *more]
    side = lambda rows, p: rows.select("band", *[F.col(c).alias(p + c) for c in cols])
    a = side(posts.where(high >= low).withColumn("band", F.explode(F.sequence(size_band(low), size_band(high)))), "a_")
    b = side(posts.where(most >= F.col("n")).withColumn("band", size_band(F.col("n"))), "b_")
    return a, b


def _meeting(posts: DataFrame, *more: str) -> DataFrame:
    """Pairs of postings of one token that length and position allow; columns of the larger set (then
    class id) have prefix ``a_``, of the smaller ``b_``."""
    a, b = _dealt(posts, *more)
    least = F.ceil(F.expr(f"{PERCENT} * (a_n + b_n) / {100 + PERCENT}"))
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_cid") > F.col("b_cid")))
    return a.join(b, (F.col("a_token") == F.col("b_token")) & (a["band"] == b["band"]) & larger & (1 + F.least("a_rest", "b_rest") >= least)).drop("band")


def _checked_pairs(posts: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components among all pairs that share a posting and pass length and position."""
    now = _labelled(posts, labels)
    pairs = _meeting(now, "label").where("a_label != b_label").select(
        F.col("a_cid").alias("x"), F.col("b_cid").alias("y"), F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()
    side = [classes.select(F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("tokens").alias("t" + c)) for c in "xy"]
    both = pairs.join(side[0], "x").join(side[1], "y").select("a", "b", "nx", "ny", "tx", "ty")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True)) >= need(nx, ny)
                    for x, y, nx, ny in zip(*(batch.column(c).to_pylist() for c in ("tx", "ty", "nx", "ny")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def _classes(sets: DataFrame) -> DataFrame:
    return written(sets.where("tokens is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "classes")


def class_links(classes: DataFrame) -> DataFrame:
    """(x, y): every link between different classes, once, inside components too.  Their number can grow
    with the square of a group of near copies, which ``linked`` avoids."""
    pairs = _meeting(_postings(classes)).select(F.col("a_cid").alias("x"), F.col("b_cid").alias("y")).distinct()
    side = [classes.select(F.col("cid").alias(c), F.col("n").alias("n" + c), F.col("tokens").alias("t" + c)) for c in "xy"]
    both = pairs.join(side[0], "x").join(side[1], "y")
    common = F.lit(PERCENT) * (F.col("nx") + F.col("ny"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                 for x, y in zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "least")), pa.array(n, pa.int64())], names=["x", "y", "least", "common"])

    counted = both.select("x", "y", "tx", "ty", common.alias("least")).mapInArrow(check, "x long, y long, least long, common long")
    return counted.where(F.col("common") * (100 + PERCENT) >= F.col("least")).select("x", "y")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_links of every row: how many other rows it links with, those with an equal set among them."""
    sets = document_sets(docs, id_col, text_col)
    classes = _classes(sets)
    links = written(class_links(classes), "links")
    rows = sets.where("tokens is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("rows"))
    both = links.union(links.select("y", "x")).join(rows.withColumnRenamed("cid", "y"), "y").groupBy("x").agg(F.sum("rows").alias("others"))
    n = rows.join(both, rows["cid"] == both["x"], "left").select("cid", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = sets.select("doc", F.when(F.col("tokens").isNotNull(), F.col("cid")).alias("cid")).join(n, "cid", "left")
    return out.select(F.when(F.col("doc") < MAX_ID, F.col("doc")).cast(docs.schema[id_col].dataType).alias(id_col),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sets_and_labels(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    sets = document_sets(docs, id_col, text_col)
    classes = _classes(sets)
    posts = _postings(classes)
    labels = classes.sparkSession.createDataFrame([], "cid long, label long")
    for seed in range(ROUNDS):
        labels = _relabel(labels, _round(posts, classes, labels, seed))
    return sets, _relabel(labels, _checked_pairs(posts, classes, labels))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_key, n, cid, label): the component (a class id) of every row; ``label`` is null for
    rows that link with nothing, and ``doc`` is 2 ** 63 - 1 for a null id."""
    sets, labels = _sets_and_labels(docs, id_col, text_col)
    may = F.when(F.col("tokens").isNotNull(), F.coalesce("label", "cid"))
    return sets.join(labels, "cid", "left").select("doc", "text_key", "n", "cid", may.alias("label"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row."""
    sets, labels = _sets_and_labels(docs, id_col, text_col)
    # The least id goes by class: first of each class's rows, then of each component's classes, and back.
    # Only a class of equal sets gathers rows, in a join of two written tables, which Spark splits.
    own = sets.where("tokens is not null").groupBy("cid").agg(F.min("doc").alias("low"))
    own = written(own.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "class-ids")
    least = written(own.groupBy("label").agg(F.min("low").alias("least")), "component-ids")
    classes = written(own.join(least, "label").select("cid", "least"), "class-components")
    out = sets.select("doc", "n", F.when(F.col("tokens").isNotNull(), F.col("cid")).alias("cid")).join(classes, "cid", "left")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(F.col("doc") < MAX_ID, F.col("doc")).cast(kind).alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.coalesce("least", "doc") < MAX_ID, F.coalesce("least", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of every component the row with the smallest id (then text hash)
    stays, once.  Rows without words all stay."""
    rows = linked(docs, id_col, text_col)
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc", "text_key")).alias("k")).select("k.*")
    keep = first.union(rows.where("label is null").select("doc", "text_key")).distinct()
    blank = ~text_or_empty(text_col).rlike(r"[^\x20\x09-\x0D]")
    own = unused(docs.columns)
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("text_key"),
                   F.when(blank, F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("row"))
    keyed = docs.withColumn(own, key)
    keep = keep.select(F.col("doc").alias("keep_doc"), F.col("text_key").alias("keep_key")).alias("keep")
    same = (F.col(f"{own}.doc") == F.col("keep.keep_doc")) & (F.col(f"{own}.text_key") == F.col("keep.keep_key"))
    return keyed.join(keep, same, "left_semi").dropDuplicates([own]).drop(own)
