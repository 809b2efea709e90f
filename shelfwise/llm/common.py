"""Shared pieces: word finding and hashing over whole Arrow batches, slices, scratch tables.

Words are ``[^\\x20\\x09-\\x0D]+``.  All byte work is numpy over the Arrow text buffer, one slice
of bounded size at a time, so memory does not follow the batch.  Hashes are 64 bits; two different
windows of one comparison collide with probability 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_table as written

__all__ = ["Words", "aside", "buffers", "byte_hashes", "covered", "drawn", "mix", "per_row", "release", "slices", "table", "text_or_empty", "unused",
           "window_hashes", "window_rows", "written", "WORD_RX"]

WORD_RX = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def unused(columns: list[str]) -> str:
    """A name for an operator's own column that no column has, whatever its case."""
    taken, name = {c.lower() for c in columns}, "_own"
    while name in taken:
        name += "_"
    return name


def aside(docs: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names for the columns that begin with an operator's own ``prefix``, and the names
    to give back (for ``withColumnsRenamed``)."""
    taken = {c.lower() for c in docs.columns}
    back = {}
    for c in docs.columns:
        if c.lower().startswith(prefix):
            name = f"given{len(back)}"
            while name in taken:
                name += "_"
            taken.add(name)
            back[name] = c
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def drawn(rows: DataFrame, draw: F.Column, limit: int) -> list:
    """The ``limit`` rows with the least draw (a 64-bit hash; ties by the row), to the driver.

    Only rows below a cut that about three times ``limit`` pass take part in the sort, so what tasks
    send does not grow with their number.
    """
    share = min(1.0, 3 * limit / max(rows.count(), 1))
    cut = int(share * (1 << 64)) - (1 << 63)
    few = rows.withColumn("_draw", draw)
    if share < 1.0:
        few = few.where(F.col("_draw") < F.lit(cut))
    return few.orderBy("_draw", *[c for c in rows.columns]).limit(limit).collect()


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of ``col`` (one row at least, 2 ** 16 at most)."""
    if not batch.num_rows:
        return
    _, offs = buffers(batch.column(batch.schema.get_field_index(col)))
    cut = 0
    while cut < batch.num_rows:
        end = int(np.searchsorted(offs, offs[cut] + limit, side="right")) - 1
        end = min(max(end, cut + 1), cut + (1 << 16), batch.num_rows)
        yield batch.slice(cut, end - cut)
        cut = end


def release() -> None:
    """Give memory that Arrow's pool and the C library keep after a slice back to the machine: workers
    stay alive between stages, beside the JVM's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string array; nulls count as empty."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


class Words:
    """Words of a slice: byte starts and ends, and ``first[d]:first[d + 1]`` as the words of row d."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.offs = offs
        if lower:
            raw = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
        self.raw = raw
        n = len(raw)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        before = np.zeros(n + 1, bool)
        before[1:] = solid
        before[self.offs] = False          # a row's first byte follows nothing
        self.starts = np.flatnonzero(solid & ~before[:n])
        after = np.zeros(n + 1, bool)
        after[:n] = solid
        after[self.offs] = False
        self.ends = np.flatnonzero(solid & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offs)

    @classmethod
    def of(cls, arr: pa.Array, lower: bool = False) -> Words:
        return cls(*buffers(arr), lower=lower)

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return byte_hashes(self.raw, self.starts, self.ends)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range, eight bytes a step."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    loads = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=_U)
    out = mix(loads[starts] & keep[np.minimum(size, 8)]) ^ mix(size.astype(_U))
    left = np.flatnonzero(size > 8)
    step = 8
    while len(left) and step < 256:
        part = loads[starts[left] + step] & keep[np.minimum(size[left] - step, 8)]
        out[left] = mix(out[left] * _U(0x9E3779B97F4A7C15) + part)
        step += 8
        left = left[size[left] > step]
    for i in left:                         # very long ranges: one call each
        out[i] = xxhash.xxh64_intdigest(raw[starts[i]:ends[i]].tobytes())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (len - k + 1 of them), by doubling."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    mul = _U((0xD6E8FEB86659FD93 + 2 * seed) % (1 << 64) | 1)
    power, span, acc, done = words, 1, None, 0
    while True:                            # binary expansion of k
        if k & span:
            part = power[done:done + n]
            acc = mix(part + _U(seed)) if acc is None else mix(acc * mul + part)
            done += span
        if done == k:
            return acc
        size = len(power) - span
        power = mix(power[:size] * mul + power[span:span + size])
        span *= 2


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every window of ``k`` words that lies within one row, and its row."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    return at, row


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` words starting at one of ``at``."""
    edge = np.bincount(at, minlength=n + k + 1)[:n + k + 1] - np.bincount(at + k, minlength=n + k + 1)[:n + k + 1]
    return np.cumsum(edge)[:n] > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per word or byte) over every row."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
