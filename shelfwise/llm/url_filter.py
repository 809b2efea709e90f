"""Operator 4, URL filters: a bit-parallel wildcard automaton.

Every glob becomes a run of bits of one multiword Shift-And state: bit j of a glob is set while
its first j literals are matched.  One step per byte moves all globs of all URLs of a batch at
once.  ``*`` keeps a bit set on any byte, ``^`` on any byte but ``/`` (a host part).

Nulls, texts without ``://`` and empty texts have an empty host and path, fit no rule and match no
glob, so they get the default verdict.  Repeated rows are judged alike; an empty table gives an
empty result.  Only ``page_id`` and ``url`` are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64

#: (host, path, verdict), as the contract lists them.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: What the method blocks where no rule fits: host and path globs of unwanted sites.
BLOCK_GLOBS = ("*cheap-pills*", "*spam-farm*", "*casino*", "*viagra*", "*porn*", "*xxx*", "*poker*", "*payday*loan*",
               "ads.*", "*.ads.*", "*doubleclick*", "*/wp-login*", "*.exe", "*.zip", "*.apk", "*/tracker/*")


class ShiftAnd:
    """Globs packed into 64-bit words; ``match`` runs them over many byte strings at once."""

    def __init__(self, globs: Sequence[str]):
        bits, loops, self.first, self.last = [], [], [], []
        for glob in globs:
            self.first.append(len(bits))
            bits.append(None)              # the start of a glob takes no byte
            loops.append("")
            for byte in glob.encode():
                if byte in b"*^":
                    loops[-1] = "*" if byte == ord("*") or loops[-1] == "*" else "^"
                else:
                    bits.append(byte)
                    loops.append("")
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.take, self.stay = (np.zeros((256, self.words), _U) for _ in range(2))
        self.start = np.zeros(self.words, _U)
        for j, byte in enumerate(bits):
            word, bit = j // 64, _U(1 << (j % 64))
            if byte is not None:
                self.take[byte, word] |= bit
            if loops[j]:
                self.stay[:, word] |= bit
            if loops[j] == "^":
                self.stay[ord("/"), word] &= ~bit
        for j in self.first:
            self.start[j // 64] |= _U(1 << (j % 64))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean row per text, a column per glob: the glob fits the whole text."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        offs = np.concatenate([[0], np.cumsum(size)])[:-1]
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        live, start = len(texts), offs[order]
        size = size[order]
        for at in range(int(size[0]) if live else 0):
            while size[live - 1] <= at:
                live -= 1
            byte, now = raw[start[:live] + at], state[:live]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[:live] = (moved & self.take[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, j in enumerate(self.last):
            out[order, k] = (state[:, j // 64] >> _U(j % 64)) & _U(1) != 0
        return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def judge_urls(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row; the longest fitting rule wins, else the globs decide."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    globs = [g for host, path, _ in ranked for g in (f"{host}{path}*", f"^.{host}{path}*")] + list(block_globs)
    automaton = ShiftAnd(globs)
    names = [host + path for host, path, _ in ranked]
    verdicts = [r[2] for r in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            parts = [(h.translate(_LOWER), p) for h, p in parts]
            hit = automaton.match([(h + p).encode() for h, p in parts])
            by_rule = hit[:, 0:2 * len(ranked):2] | hit[:, 1:2 * len(ranked):2]
            fits = by_rule.any(axis=1) if ranked else np.zeros(len(parts), bool)
            best = by_rule.argmax(axis=1) if ranked else np.zeros(len(parts), int)
            bad = hit[:, 2 * len(ranked):].any(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([names[b] if f else None for f, b in zip(fits, best)], pa.string()),
                pa.array([verdicts[b] if f else ("block" if x else "allow") for f, b, x in zip(fits, best, bad)], pa.string()),
                pa.array(bad)], names=[id_col, "host", "path", "rule", "verdict", "glob_hit"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, pages[url_col].cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, glob_hit boolean")
