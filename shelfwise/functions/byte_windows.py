"""Which of many terms occur in which texts, over the bytes of whole Arrow batches.

In UTF-8 a text contains a term exactly if its bytes do.  A term of up to eight bytes is a number
(its bytes); the numbers at every place of a text are one unaligned view of its buffer, so each length is
one vectorised pass.  Longer terms are looked for where their first eight bytes occur.  A Bloom filter
of the terms is tested first at every place, the terms' sorted keys after it where it says yes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = 8
SLICE_BYTES = 1 << 20
FILTER_LOG = 23            # the filter has 2 ** 23 places, whatever the number of terms
_U = np.uint64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(WORD)] + [(1 << 64) - 1], dtype=_U)
_MUL, _AGAIN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_SEEDS = (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number (zeros beyond the end)."""
    padded = np.concatenate([raw, np.zeros(WORD, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def window_keys(loads: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of the ``n`` bytes from each place: up to eight bytes these bytes and their
    number; beyond, two hashes."""
    if n <= WORD:
        return loads[at] & _KEEP[n], np.full(len(at), n, _U)
    out = [np.full(len(at), (seed + n) % (1 << 64), _U) for seed in _SEEDS]
    for step in range(0, n, WORD):
        part = loads[at + step] & _KEEP[min(n - step, WORD)]
        out = [_mix(h * _MUL + part) for h in out]
    return out[0], out[1]


def term_keys(terms: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, first key, second key, key of the first eight bytes) of every term."""
    raw, offs = _buffers(terms)
    size = np.diff(offs)
    one, two, lead = np.zeros(len(size), _U), np.zeros(len(size), _U), np.zeros(len(size), _U)
    loads = _loads(raw)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        one[which], two[which] = window_keys(loads, offs[which], n)
        lead[which] = window_keys(loads, offs[which], min(n, WORD))[0]
    return size, one, two, lead


class TermSet:
    """Keys of a bounded number of terms: by length, behind a Bloom filter."""

    def __init__(self, size: np.ndarray, one: np.ndarray, lead: np.ndarray):
        self.short = {int(n): np.sort(one[size == n]) for n in np.unique(size[(size > 0) & (size <= WORD)])}
        self.long = {int(n): np.sort(one[size == n]) for n in np.unique(size[size > WORD])}
        self.lead = np.unique(lead[size > WORD])

    def filter(self) -> np.ndarray:
        bits = np.zeros(1 << FILTER_LOG, bool)
        for n, keys in [*self.short.items(), (0, self.lead)]:
            for mul in (_MUL, _AGAIN):
                bits[_spots(keys, n, mul)] = True
        return bits


def _spots(keys: np.ndarray, n: int, mul: np.uint64) -> np.ndarray:
    """Places in the filter of keys of the class ``n``."""
    return ((keys + _KEEP[n]) * mul) >> _U(64 - FILTER_LOG)


def _held(keys: np.ndarray, n: int, wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in ``keys`` whose key is wanted."""
    at = np.flatnonzero(bits[_spots(keys, n, _MUL)])
    at = at[bits[_spots(keys[at], n, _AGAIN)]]
    return at[_among(keys[at], wanted)]


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[place] == keys


def found(raw: np.ndarray, offs: np.ndarray, terms: TermSet, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first key, second key) of every term that a row's text contains, once."""
    loads = _loads(raw)
    first = loads[:len(raw)]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    rows, ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)]

    def fits(at: np.ndarray, n: int) -> np.ndarray:
        """Those places from which ``n`` bytes are left in their row."""
        return at[at + n <= offs[1:][row[at]]]

    def take(at: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = np.lexsort((one, row[at]))
        r, k, s = row[at][order], one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        rows.append(r[new])
        ones.append(k[new])
        twos.append(s[new])

    for n, wanted in terms.short.items():
        at = fits(_held(first & _KEEP[n], n, wanted, bits), n)
        take(at, *window_keys(loads, at, n))
    if terms.long:
        at = _held(first, 0, terms.lead, bits)
        for n, wanted in terms.long.items():
            some = fits(at, n)
            one, two = window_keys(loads, some, n)
            hit = _among(one, wanted)
            take(some[hit], one[hit], two[hit])
    return np.concatenate(rows), np.concatenate(ones), np.concatenate(twos)


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def scan(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], terms: TermSet) -> Iterator[pa.RecordBatch]:
    """Per batch: the columns ``keep`` and both keys of every term found, a row per text and term."""
    bits = terms.filter()
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index(text))
        _, offs = _buffers(column)
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            rows, one, two = found(*_buffers(column.slice(at, end - at)), terms, bits)
            taken = pa.array(rows + at)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(taken) for c in keep),
                                              pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=[*keep, "one", "two"])
            at = end
