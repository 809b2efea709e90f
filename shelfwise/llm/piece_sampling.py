"""Operator 8, SentencePiece encoding and decoding: distinct sampled segmentations.

Every text is a lattice of pieces.  A segmentation's weight is the product of its pieces' weights
(Zipf by vocabulary rank, since the model is BPE and its scores are ranks).  The ``samples`` drawn
are the Gumbel top-k: the segmentations with the greatest perturbed log-probabilities, hence without
replacement.  They are found by A* over prefixes: the best perturbed value below a prefix is known
exactly (an exponential clock with the prefix's probability as its rate), so each search step takes
the best open prefix, draws its best completion, and opens the prefixes that leave that completion.

Pieces never cross a unit (a run of blanks and what follows up to the next blank or line end), so
the lattice of a text is a chain of unit lattices; those are built once for each distinct unit of a
slice, with numpy over all of them.  Random numbers are hashes of seed, row key, sample, unit and
offset: a row's samples do not depend on the batch it is in.

A row's ``inclusion`` is the chance that its segmentation ends above the best value left out, given
that value; 1 where the text has no more segmentations, of which fewer than ``samples`` may exist.
Null and empty texts have one segmentation without pieces.  U+2581 counts as a blank, as the model
writes it.  Rows that share a key and a text get the same samples; a null key is one key.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import byte_hashes, mix, release, slices, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 8
SHARPNESS = 1.0            # exponent of the pieces' weights
SLICE = 1 << 20            # text of a slice: its arrays take about 150 times as much
SLOPE, LONG = 6.0, 120     # scale of unit sums (nats a character), and how long a unit they serve
BLANK = "▁"
FIXED = float(1 << 40)     # log-probabilities are added as integers: exact, whatever shares a slice
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, ``counts`` of each."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


class Places:
    """Where each of some distinct 64-bit keys stands among them: an open table with free places."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = _U(64 - max(4, int(4 * len(keys)).bit_length()))
        self.table = np.full((1 << (64 - int(self.shift))) + len(keys) + 1, -1, np.int32)
        for k, place in enumerate(self._first(keys).tolist()):
            while self.table[place] >= 0:
                place += 1
            self.table[place] = k

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> _U(31))) * _MUL) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are keys (ascending), and their numbers."""
        place = self._first(h)
        at, found = np.arange(len(h)), np.full(len(h), -1, np.int32)
        while len(at):
            k = self.table[place]
            taken = np.flatnonzero(k >= 0)     # a free place ends the search
            at, place, k = at[taken], place[taken], k[taken]
            same = self.keys[k] == h[at]
            found[at[same]] = k[same]
            more = np.flatnonzero(~same)
            at, place = at[more], place[more] + 1
        seen = np.flatnonzero(found >= 0)
        return seen, found[seen]


class Pieces:
    """The vocabulary as hash tables by piece length."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        kinds = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.text = [b""] * n
        by_length: dict[int, list[tuple[int, int]]] = {}
        starts: dict[int, set[int]] = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not kinds[i]:
                if "\n" in name or re.search(f"[^{BLANK}]{BLANK}", name):
                    raise ValueError(f"piece {i} crosses a unit")
                self.text[i] = name.replace(BLANK, " ").encode()
                by_length.setdefault(len(name), []).append((int(_hash_one(name)), i))
                for k in range(1, len(name)):
                    starts.setdefault(k, set()).add(int(_hash_one(name[:k])))
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_size = np.array([len(t) for t in self.text], np.int64)
        self.text_first = np.cumsum(self.text_size) - self.text_size
        self.longest = max(by_length)
        self.tables = {}                   # by length: hashes, piece or -1, whether longer pieces begin so
        for size in range(1, self.longest + 1):
            own, begun = dict(by_length.get(size, [])), starts.get(size, set())
            keys = sorted(own.keys() | begun)
            self.tables[size] = (np.array(keys, _U), np.array([own.get(h, -1) for h in keys], np.int32),
                                 np.array([h in begun for h in keys], bool))
        self.places = {size: Places(keys) for size, (keys, _, _) in self.tables.items()}
        self.weight = (-sharpness * np.log(2.0 + np.arange(n))).astype(np.float64)
        self.byte_weight = -sharpness * float(np.log(2.0 + n))

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces after each other, and how many each piece has."""
        many = self.text_size[ids]
        return self.text_bytes[spread(self.text_first[ids], many)], many

    def decode(self, ids) -> str:
        return b"".join([self.text[i] for i in ids])[1:].decode(errors="replace")


def _hash_one(name: str) -> np.uint64:
    h = _U(0)
    with np.errstate(over="ignore"):
        for c in name:
            h = h * _MUL + _U(ord(c) + 1)
    return h


class Lattice:
    """Unit lattices side by side.  Position p of the joined characters has edges ``first[p]`` to
    ``first[p] + count[p]``, the longest piece first: the piece (-2: the bytes of a character that the
    vocabulary lacks), the chance to take it, and the running sum of the chances."""

    def __init__(self, pieces: Pieces, units: list[str]):
        chars = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), np.uint32)
        size = np.array([len(u) for u in units], np.int64)
        self.end = np.cumsum(size + 1) - 1     # a place of its own, with no edges
        self.base = self.end - size
        self.code = chars
        n = len(chars)
        left = np.repeat(self.end, size + 1) - np.arange(n)
        hits = []
        code = chars.astype(_U) + _U(1)
        at, h = np.arange(n), np.zeros(n, _U)
        for k in range(1, pieces.longest + 1):
            more = left[at] >= k
            at, h = at[more], h[more]
            if not len(at):
                break
            h = h * _MUL + code[at + k - 1]
            _, ids, begun = pieces.tables[k]
            seen, place = pieces.places[k].find(h)
            at, h = at[seen], h[seen]
            ids = ids[place]
            good = np.flatnonzero(ids >= 0)
            hits.append((k, at[good], ids[good], pieces.weight[ids[good]]))
            more = np.flatnonzero(begun[place])
            at, h = at[more], h[more]
        known = np.zeros(n, bool)
        for k, found, _, _ in hits:
            if k == 1:
                known[found] = True
        spelled = np.flatnonzero(~known & (left > 0))
        many = 1 + (chars[spelled] >= 0x80) + (chars[spelled] >= 0x800) + (chars[spelled] >= 0x10000)
        hits.append((1, spelled, np.full(len(spelled), -2, np.int32), pieces.byte_weight * many))

        self.count = np.zeros(n, np.int64)
        for _, found, _, _ in hits:
            self.count[found] += 1
        self.first = np.cumsum(self.count) - self.count
        edges = int(self.count.sum())
        self.piece, self.size = np.empty(edges, np.int32), np.empty(edges, np.int32)
        weight, filled = np.empty(edges), np.zeros(n, np.int64)
        for k, found, ids, w in sorted(hits, key=lambda x: -x[0]):
            slot = self.first[found] + filled[found]
            filled[found] += 1
            self.piece[slot], self.size[slot], weight[slot] = ids, k, w
        self.pos = np.repeat(np.arange(n, dtype=np.int32), self.count)
        # Backward sums by distance to the end of the unit: scaled by SLOPE a character, which keeps
        # units up to LONG characters in range; longer ones in logarithms.
        long = np.repeat(size > LONG, size + 1)
        ahead = self.pos + self.size
        scaled = np.exp(weight + SLOPE * self.size)
        beta = np.where(long, -np.inf, 0.0)
        beta[self.end] = np.where(size > LONG, 0.0, 1.0)
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        slow_too = bool((size > LONG).any())
        for d in range(len(cuts) - 1):
            here = order[cuts[d]:cuts[d + 1]]
            rank, at = 0, here[~long[here]] if slow_too else here
            while len(at):
                e = self.first[at] + rank
                beta[at] += scaled[e] * beta[ahead[e]]
                rank += 1
                at = at[self.count[at] > rank]
            rank, at = 0, here[long[here]] if slow_too else here[:0]
            while len(at):
                e = self.first[at] + rank
                beta[at] = np.logaddexp(beta[at], weight[e] + beta[ahead[e]])
                rank += 1
                at = at[self.count[at] > rank]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            self.chance = scaled * beta[ahead] / beta[self.pos]
        if slow_too:
            slow = np.flatnonzero(long[self.pos])
            self.chance[slow] = np.exp(weight[slow] + beta[ahead[slow]] - beta[self.pos[slow]])
        self.upto = self.chance.copy()
        at, rank = np.flatnonzero(self.count > 1), 1
        while len(at):
            e = self.first[at] + rank
            self.upto[e] += self.upto[e - 1]
            rank += 1
            at = at[self.count[at] > rank]
        self.unlikely = bool((self.chance <= 0).any())
        some = self.count > 0
        self.upto[self.first[some] + self.count[some] - 1] = 2.0       # rounding never leaves a draw without an edge

    def take(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that each draw takes at its position."""
        e = self.first[at]
        more = np.flatnonzero(u >= self.upto[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.upto[e[more]]]
        for k in np.flatnonzero(self.chance[e] <= 0) if self.unlikely else ():     # rounding again
            e[k] = self.first[at[k]] + int(np.argmax(self.chance[self.first[at[k]]:self.first[at[k]] + self.count[at[k]]]))
        return e

    def take_other(self, at: int, barred: int, u: float) -> int:
        """The edge that a draw takes among those whose bits are not set in ``barred``."""
        first = int(self.first[at])
        free = [k for k in range(int(self.count[at])) if not barred >> k & 1]
        sums = np.cumsum(self.chance[first + np.array(free)])
        k = min(int(np.searchsorted(sums, u * sums[-1], side="right")), len(free) - 1)
        return first + free[k]

    def barred_chance(self, at: int, barred: int) -> float:
        first = int(self.first[at])
        return float(sum(self.chance[first + k] for k in range(int(self.count[at])) if barred >> k & 1))


def units_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of the texts, the units of all texts in order (as numbers), and how many each
    text has.  A unit is a run of blanks and what follows it up to the next blank or line end; line
    ends stand alone; a text that is not empty begins with a blank."""
    coded = [(" " + t.replace(BLANK, " ")).encode() if t else b"" for t in texts]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    line, blank = raw == 10, raw == 32
    begin = line | blank
    begin[1:] &= line[1:] | ~blank[:-1]    # only the first blank of a run
    begin[1:] |= line[:-1]
    begin[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(raw))[:len(starts)]
    _, one, number = np.unique(byte_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    data = raw.tobytes()
    units = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    if units and b"\0" not in data:        # all at once, with a mark between them
        units = b"\0".join(units).decode().replace(" ", BLANK).split("\0")
    else:
        units = [u.decode().replace(" ", BLANK) for u in units]
    return units, number, np.diff(np.searchsorted(starts, offs))


def _salt(n: int) -> np.uint64:
    return _U((n * int(_MUL)) % (1 << 64))


def _draw(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes; ``key`` comes salted and mixed."""
    h = mix(key ^ (a.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + b.astype(_U) * _U(0x165667B19E3779F9)))
    return ((h >> _U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def sample(pieces: Pieces, texts: list[str], keys: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple]]:
    """Per sample rank, per text: (ids, log-probability, perturbed value), or None; and, last, per
    text the best perturbed value that was left out (-inf if there is none)."""
    rows = len(texts)
    units, unit, n_units = units_of(texts)
    first = np.concatenate([[0], np.cumsum(n_units)])
    row_of = np.repeat(np.arange(rows), n_units)
    lattice = Lattice(pieces, units)
    base, end = lattice.base[unit], lattice.end[unit]
    keys = mix(keys.astype(_U) + _salt(seed))

    log_tau = np.log(-np.log(_draw(mix(keys + _salt(1)), np.zeros(rows), np.zeros(rows))))
    # A node: the path and decision where it leaves its parent, and the edges (bits) taken there so far.
    parent = np.zeros(rows, np.int64)
    keep = np.zeros(rows, np.int64)
    barred = np.zeros(rows, np.int64)
    live = np.ones(rows, bool)
    store = {k: np.zeros(0, np.int64) for k in ("unit", "edge", "logp")}
    path_first: list[np.ndarray] = []
    pool: list[tuple] = []
    out = []
    for r in range(samples + 1):
        if r == samples:
            out.append(np.where(live, -log_tau, -np.inf))
            break
        # The first decision of each live row, then everything after it, drawn anew.
        busy = live & (n_units > 0)
        turn = np.flatnonzero(busy)
        start_unit = first[:-1].copy()
        if r:
            node = np.zeros(rows, np.int64)
            for p, starts in enumerate(path_first):
                node = np.where(busy & (parent == p), starts + keep, node)
            start_unit[turn] = store["unit"][node[turn]]
        rest = np.where(busy, first[1:] - start_unit, 0)
        act = spread(start_unit, rest)
        pos = base[act].copy()
        lead = np.cumsum(rest) - rest      # index in ``act`` of each row's first unit
        if r:
            pos[lead[turn]] = lattice.pos[store["edge"][node[turn]]]
        owner = row_of[act]
        which = np.arange(len(act))
        salted, nth = mix(keys + _salt(16 + r))[owner], act - first[owner]
        start, stop = base[act], end[act]
        steps: list[tuple] = []
        count = np.zeros(len(act), np.int64)
        while len(which):
            at = pos[which]
            u = _draw(salted[which], nth[which], at - start[which])
            e = lattice.take(at, u)
            if not steps and r:            # what the parent and its siblings took is barred
                for d, k in zip(turn.tolist(), lead[turn].tolist()):
                    e[k] = lattice.take_other(int(at[k]), int(barred[d]), float(u[k]))
            steps.append((which, e))
            count[which] += 1
            at = at + lattice.size[e]
            pos[which] = at
            which = which[at < stop[which]]
        slot = np.cumsum(count) - count
        edge = np.zeros(int(count.sum()), np.int64)
        for k, (which, e) in enumerate(steps):
            edge[slot[which] + k] = e
        new = {"unit": np.repeat(act, count), "edge": edge, "logp": np.rint(np.log(lattice.chance[edge]) * FIXED).astype(np.int64)}
        sums = np.concatenate([[0], np.cumsum(count)])
        fresh = np.zeros(rows, np.int64)
        fresh[turn] = sums[lead[turn] + rest[turn]] - sums[lead[turn]]
        # Whole paths: the kept decisions of the parent, then the new ones.
        kept = np.where(busy, keep, 0)
        length = kept + fresh
        path_from = np.cumsum(length) - length
        shift = len(store["unit"])
        if r:
            kept_from = np.zeros(rows, np.int64)
            for p, starts in enumerate(path_first):
                kept_from = np.where(parent == p, starts, kept_from)
            source = np.empty(int(length.sum()), np.int64)
            source[spread(path_from, kept)] = spread(kept_from, kept)
            source[spread(path_from + kept, fresh)] = spread(np.cumsum(fresh) - fresh, fresh) + shift
            path = {k: np.concatenate([store[k], new[k]])[source] for k in store}
        else:
            path = new
        if r < samples - 1:
            store = {k: np.concatenate([store[k], path[k]]) for k in store} if r else path
        path_first.append(path_from + shift)
        sums = np.concatenate([[0], np.cumsum(path["logp"])])
        log_prob = (sums[path_from + length] - sums[path_from]) / FIXED
        out.append((path["edge"], path_from, length, log_prob, np.where(live, -log_tau, -np.inf), live.copy()))

        # Prefixes that leave this path: their clocks start when it fires.
        opened = spread(path_from + kept, fresh)
        row = np.repeat(np.arange(rows), fresh)
        e = path["edge"][opened]
        at = lattice.pos[e]
        away = 1.0 - lattice.chance[e]
        options = lattice.count[at] - 1
        begin = np.cumsum(fresh) - fresh
        if r:
            for d in turn.tolist():
                k = begin[d]
                away[k] -= lattice.barred_chance(int(at[k]), int(barred[d]))
                options[k] -= int(barred[d]).bit_count()
        some = np.flatnonzero(options > 0)     # where one edge is left, nothing leaves the path
        opened, row, e, at = opened[some], row[some], e[some], at[some]
        unit_at = path["unit"][opened]
        wait = -np.log(_draw(mix(keys + _salt(4096 + r))[row], unit_at - first[row], at - base[unit_at]))
        delay = np.log(wait / np.maximum(away[some], 1e-300)) - (sums[opened] - sums[path_from[row]]) / FIXED
        groups = np.searchsorted(row, np.arange(rows + 1))
        full = np.flatnonzero(np.diff(groups))
        for _ in range(samples - r):       # the earliest of each row, as many as may still be taken
            if not len(full):
                break
            low = np.full(rows, np.inf)
            low[full] = np.minimum.reduceat(delay, groups[full])
            hit = np.flatnonzero((delay == low[row]) & np.isfinite(delay))
            rows_hit, one = np.unique(row[hit], return_index=True)
            hit = hit[one]
            if not len(hit):
                break
            place = opened[hit] - path_from[rows_hit]
            bits = np.int64(1) << (e[hit] - lattice.first[at[hit]])
            bits = np.where(place == kept[rows_hit], bits | barred[rows_hit], bits)
            pool.append((rows_hit, np.logaddexp(log_tau[rows_hit], delay[hit]), np.full(len(hit), r), place, bits))
            delay[hit] = np.inf
        # The earliest open prefix of every row is searched next.
        live = np.zeros(rows, bool)
        if pool:
            who, when, whose, where, masks = (np.concatenate([x[k] for x in pool]) for k in range(5))
            order = np.lexsort((when, who))
            head = np.ones(len(order), bool)
            head[1:] = who[order][1:] != who[order][:-1]
            best = order[head]
            live[who[best]] = True
            log_tau = log_tau.copy()
            barred = np.zeros(rows, np.int64)
            log_tau[who[best]], parent[who[best]], keep[who[best]], barred[who[best]] = when[best], whose[best], where[best], masks[best]
            stay = np.ones(len(who), bool)
            stay[best] = False
            pool = [(who[stay], when[stay], whose[stay], where[stay], masks[stay])]
    return _results(pieces, lattice, out)


def _results(pieces: Pieces, lattice: Lattice, out: list) -> list:
    ranked = []
    for edge, path_from, length, log_prob, value, live in out[:-1]:
        ids = lattice.piece[edge]
        as_bytes = np.flatnonzero(ids == -2)
        if len(as_bytes):                  # characters outside the vocabulary become their bytes
            codes, which = np.unique(lattice.code[lattice.pos[edge[as_bytes]]], return_inverse=True)
            spelled = [pieces.byte_ids[list(chr(c).encode())] for c in codes.tolist()]
            size = np.array([len(s) for s in spelled], np.int64)
            many = np.ones(len(ids), np.int64)
            many[as_bytes] = size[which]
            place = np.cumsum(many) - many
            wide = np.repeat(ids, many)
            wide[spread(place[as_bytes], size[which])] = np.concatenate(spelled)[spread((np.cumsum(size) - size)[which], size[which])]
            sums = np.concatenate([[0], np.cumsum(many)])
            path_from, length, ids = sums[path_from], sums[path_from + length] - sums[path_from], wide
        ranked.append((ids, path_from, length, log_prob, value, live))
    return [*ranked, out[-1]]


def _spells(pieces: Pieces, ids: np.ndarray, offs: np.ndarray, plain: list[bytes]) -> np.ndarray:
    """Whether each row's pieces decode to its text."""
    data, many = pieces.spell(ids)
    sums = np.concatenate([[0], np.cumsum(many)])
    start, stop = sums[offs[:-1]], sums[offs[1:]]
    size = np.array([len(p) for p in plain], np.int64)
    ok = stop - start == size
    want = np.frombuffer(b"".join(p for p, k in zip(plain, ok) if k), np.uint8)
    wrong = np.concatenate([[0], np.cumsum(data[spread(start[ok], size[ok])] != want)])
    ends = np.cumsum(size[ok])
    ok[np.flatnonzero(ok)[wrong[ends] != wrong[ends - size[ok]]]] = False
    return ok


_PIECES: dict = {}


def pieces_of(model: bytes, sharpness: float = SHARPNESS) -> Pieces:
    """The vocabulary's tables, made once for a worker (tasks import this module for that)."""
    key = (model, sharpness)
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(model, sharpness)
    return _PIECES[key]


def encode_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
                   samples: int = SAMPLES, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """id, rank, ids, n_pieces, log_prob, perturbed, inclusion, decodes for every sample of every row."""
    with open(model, "rb") as f:           # on the driver; the bytes travel with the function
        proto = f.read()
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit("key"), F.col(id_col)).alias("key"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shelfwise.llm import piece_sampling as own        # the worker's module, which outlives the task
        pieces = own.pieces_of(proto, sharpness)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                *ranked, best_left = sample(pieces, texts, part.column("key").to_numpy(zero_copy_only=False), samples, seed)
                plain = [(" " + t.replace(BLANK, " ")).encode() if t else b"" for t in texts]
                for rank, (ids, start, length, log_prob, value, live) in enumerate(ranked):
                    rows = np.flatnonzero(live)
                    offs = np.concatenate([[0], np.cumsum(length[rows])]).astype(np.int32)
                    flat = ids[spread(start[rows], length[rows])]
                    ok = _spells(pieces, flat, offs, [plain[d] for d in rows.tolist()])
                    with np.errstate(over="ignore"):
                        chance = -np.expm1(-np.exp(np.minimum(log_prob[rows] - best_left[rows], 700.0)))
                    yield pa.RecordBatch.from_arrays([
                        part.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), rank + 1, np.int32)),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.int32))), pa.array(length[rows].astype(np.int64)),
                        pa.array(log_prob[rows]), pa.array(value[rows]), pa.array(chance), pa.array(ok, pa.bool_())],
                        names=["id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "decodes"])
                del texts, plain, ranked, best_left, ids, start, length, log_prob, value, live, rows, offs, flat, ok, chance
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id {kind}, rank int, ids array<int>, n_pieces long, log_prob double, perturbed double, inclusion double, decodes boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of every id list (null for a null list)."""
    with open(model, "rb") as f:
        proto = f.read()

    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from shelfwise.llm import piece_sampling as own
        pieces = own.pieces_of(proto)
        for lists in batches:
            yield lists.map(lambda ids: None if ids is None else pieces.decode(ids))

    return encoded.withColumn(out_col, F.pandas_udf(spell, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids_col)))
