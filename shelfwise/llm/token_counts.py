"""Operator 10, token counts: edit-aware counting on pre-token segment trees.

A document's pre-tokens are kept in leaves of about ``LEAF`` of them; a segment tree sums characters
and tokens over the leaves.  An edit is placed by descending the character sums.  Only the leaves it
touches, with two characters of context before it, are split and encoded again, going on leaf by
leaf until a pre-token ends where an old leaf ended (from there on the old pre-tokens hold); then
the sums on the way to the root are updated.  Counts equal those of encoding the edited text anew.

A tree travels as its leaves (``tree``: characters and tokens of every leaf), so it can be stored with
the document and taken up again.  Null texts are empty.  Edits apply in order, each to the text left by
the one before; positions are code points, clipped to the text; null positions are 0 and null
insertions empty.  No or null edits leave a document as it is.  Repeated rows are handled each for
itself; an empty table gives an empty result; other columns pass through unread, and those that the
operator adds replace columns of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import aside, slices, text_or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64                  # pre-tokens a new leaf holds
CONTEXT = 2                # code points before an edit that may change how it is split
CACHED = 200_000           # pre-tokens whose counts a task remembers
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


class Counter:
    """Splits text and counts the tokens of pre-tokens."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.rx = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, pre_tokens: list[str]) -> int:
        known, total = self.known, 0
        for p in pre_tokens:
            n = known.get(p)
            if n is None:
                n = len(self.bpe.encode_ordinary(p))
                if len(p) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def leaves(self, pre_tokens: list[str]) -> list[tuple[str, int]]:
        """(text, tokens) of leaves of ``LEAF`` pre-tokens."""
        parts = [pre_tokens[a:a + LEAF] for a in range(0, len(pre_tokens), LEAF)]
        return [("".join(p), self.count(p)) for p in parts]


class TokenTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, counter: Counter, texts: list[str], tokens: list[int]):
        self.counter = counter
        self.encoded = 0                   # pre-tokens encoded again by edits
        self._grow(texts or [""], tokens or [0])

    def _grow(self, texts: list[str], tokens: list[int]) -> None:
        self.texts = texts
        self.width = 1 << (len(texts) - 1).bit_length()
        pad = [0] * (self.width - len(texts))
        self.chars = [0] * self.width + [len(t) for t in texts] + pad
        self.tokens = [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        i = leaf + self.width
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds code point ``char`` (the last leaf beyond the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if char >= start + self.chars[i] and self._reaches(i + 1):
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def _reaches(self, i: int) -> bool:
        """The subtree at ``i`` holds a leaf of the document."""
        while i < self.width:
            i *= 2
        return i - self.width < len(self.texts)

    def edit(self, start: int | None, stop: int | None, text: str | None) -> None:
        total = self.chars[1]
        start = min(max(start or 0, 0), total)
        stop = min(max(stop or 0, start), total)
        first, at = self._leaf_at(max(start - CONTEXT, 0))
        last, _ = self._leaf_at(stop)
        old = "".join(self.texts[first:last + 1])
        new = old[:start - at] + (text or "") + old[stop - at:]
        ends, kept = len(new), last
        pre_tokens: list[str] = []
        done = 0
        while True:                        # split until a pre-token ends with an old leaf
            ahead = "" if kept + 1 >= len(self.texts) else self._ahead(kept + 1)
            for m in self.counter.rx.finditer(new + ahead, done):
                if m.end() > ends:
                    break
                pre_tokens.append(m.group())
                done = m.end()
            if done == ends:
                break
            kept += 1
            new += self.texts[kept]
            ends = len(new)
        self.encoded += len(pre_tokens)
        leaves = self.counter.leaves(pre_tokens)
        if len(leaves) <= kept - first + 1:
            for k in range(first, kept + 1):
                self._set(k, *(leaves[k - first] if k - first < len(leaves) else ("", 0)))
        else:                              # more leaves than places: the tree grows
            tokens = self.tokens[self.width:self.width + len(self.texts)]
            self._grow(self.texts[:first] + [t for t, _ in leaves] + self.texts[kept + 1:],
                       tokens[:first] + [n for _, n in leaves] + tokens[kept + 1:])

    def _ahead(self, leaf: int) -> str:
        """Text after a boundary, as far as a split before it may look: the first leaf that is not blank ends it."""
        out = []
        while leaf < len(self.texts):
            out.append(self.texts[leaf])
            if out[-1].strip():
                break
            leaf += 1
        return "".join(out)

    @property
    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.width:self.width + len(self.texts)]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:            # on the driver; the bytes travel with the function
        return f.read()


def _with_columns(df: DataFrame, new: dict[str, str]) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in new]
    return T.StructType(fields + [T.StructField(n, T.StructType.fromDDL(f"x {k}")["x"].dataType) for n, k in new.items()])


def count_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``tree``."""
    data = _read(vocabulary)
    docs, back = aside(docs, "_count_")
    keep = [c for c in docs.columns if c not in ("n_tokens", "tree")]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("_count_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(data)
        for batch in batches:
            for part in slices(batch, "_count_text"):
                leaves = [counter.leaves(counter.rx.findall(t)) for t in part.column("_count_text").to_pylist()]
                tree = [{"chars": [len(t) for t, _ in x], "tokens": [n for _, n in x]} for x in leaves]
                kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array([sum(x["tokens"]) for x in tree], pa.int64()),
                                                  pa.array(tree, kind)], names=[*keep, "n_tokens", "tree"])

    return narrow.mapInArrow(run, _with_columns(narrow.drop("_count_text"), {"n_tokens": "bigint", "tree": TREE})).withColumnsRenamed(back)


def apply_edits(counted: DataFrame, edits_col: str = "edits", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``counted`` after its edits: new text, ``tree`` and ``n_tokens``, and ``n_encoded``, the pre-tokens
    that were encoded again."""
    data = _read(vocabulary)
    new = {text_col: "string", "n_tokens": "bigint", "tree": TREE, "n_encoded": "bigint"}
    counted, back = aside(counted, "_count_")
    edits_col = {c: name for name, c in back.items()}.get(edits_col, edits_col)
    keep = [c for c in counted.columns if c not in new]
    narrow = counted.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("_count_text"), F.col("tree").alias("_count_tree"),
                            F.col(edits_col).cast(EDITS).alias("_count_edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(data)
        kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch, "_count_text"):
                texts, totals, trees, encoded = [], [], [], []
                for text, tree, edits in zip(*(part.column(c).to_pylist() for c in ("_count_text", "_count_tree", "_count_edits"))):
                    cuts = [0]
                    for n in tree["chars"]:
                        cuts.append(cuts[-1] + n)
                    own = TokenTree(counter, [text[a:b] for a, b in zip(cuts, cuts[1:])], list(tree["tokens"]))
                    for e in edits or []:
                        if e is not None:
                            own.edit(e["start"], e["stop"], e["text"])
                    texts.append("".join(own.texts))
                    totals.append(own.tokens[1])
                    trees.append({"chars": [len(t) for t in own.texts], "tokens": own.leaf_tokens})
                    encoded.append(own.encoded)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(totals, pa.int64()),
                                                  pa.array(trees, kind), pa.array(encoded, pa.int64())], names=[*keep, *new])

    return narrow.mapInArrow(run, _with_columns(counted.select(*[F.col(f"`{c}`") for c in keep]), new)).withColumnsRenamed(back)


def sample_edits(key: Column, text: Column, word: Column) -> Column:
    """Three edits of every document, drawn by its key: a word replaces some characters, a few
    characters go, and the start of the text is put in again elsewhere."""
    size = F.length(text).cast("long")

    def place(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), key), size + 1)

    def edit(start: Column, length: int, text: Column) -> Column:
        return F.struct(start.alias("start"), (start + length).alias("stop"), text.alias("text"))

    return F.array(edit(place(1), 12, word), edit(place(2), 30, F.lit("")), edit(place(3), 0, F.substring(text, 1, 40)))


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "source") -> DataFrame:
    """Token counts of every document before and after its sampled edits."""
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col), text.alias("text"), sample_edits(F.col(id_col), text, F.col(word_col).cast("string")).alias("edits"))
    before = count_tokens(narrow).withColumnRenamed("n_tokens", "n_before").withColumn("n_leaves", F.size("tree.chars").cast("long"))
    after = apply_edits(before)
    return after.select(id_col, "n_before", "n_leaves", F.size("edits").cast("long").alias("n_edits"), F.col("n_tokens").alias("n_after"),
                        "n_encoded", F.sha2(F.col("text"), 256).alias("edited_sha256"))
