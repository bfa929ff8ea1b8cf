"""Looks a block of quotes up in one text: places of equal runs, and near runs. Plain Python and numpy, for Arrow batches."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np

_DIGITS = re.compile(r"\d+")
#: Cells (quotes times words) that are compared at once.
CELLS = 1 << 21


def numbers(line: str) -> list[str]:
    return sorted(_DIGITS.findall(line))


class Runs:
    """A text's words, indexed for some quotes (tuples of words)."""

    def __init__(self, words: list[str], quotes: list[tuple[str, ...]]):
        self.words = tuple(words)
        self.at: dict[str, list[int]] = {w: [] for q in quotes for w in q}
        for i, w in enumerate(words):
            if (places := self.at.get(w)) is not None:
                places.append(i)
        self._digits: np.ndarray | None = None
        self._ends: np.ndarray | None = None

    def places(self, q: tuple[str, ...], start: int = 0) -> Iterator[int]:
        """Where all words of q stand in order, from ``start`` on; looked up at its rarest word."""
        off = min(range(len(q)), key=lambda k: len(self.at[q[k]]))
        for p in self.at[q[off]]:
            if (s := p - off) >= start and self.words[s : s + len(q)] == q:
                yield s

    def in_order(self, parts: list[tuple[str, ...]]) -> int | None:
        """Where the first of some parts stands that all stand one after another."""
        first, upto = None, 0
        for p in parts:
            if (at := next(self.places(p, upto), None)) is None:
                return None
            first, upto = at if first is None else first, at + len(p)
        return first

    def _counts(self) -> np.ndarray:
        """How many numbers stand before each word."""
        if self._digits is None:
            some = _DIGITS.search(" ".join(self.words))
            n = np.fromiter((len(_DIGITS.findall(w)) for w in self.words), np.int64, len(self.words)) if some else np.zeros(len(self.words), np.int64)
            self._digits = np.concatenate(([0], np.cumsum(n)))
        return self._digits

    def nearest(self, quotes: list[tuple[str, ...]], own: list[list[str]], least: float, first: bool = False, autojunk: bool = True) -> dict[int, tuple[float, int]]:
        """(ratio, start) by the quote's position: of the runs of as many words as a quote that hold at least half as many of
        its distinct words and the same numbers (``own`` has the quotes') the best from ``least`` on, of equals the last; with
        ``first`` any of them."""
        by_length = defaultdict(list)
        for i, q in enumerate(quotes):
            if len(q) <= len(self.words) and 2 * sum(1 for w in set(q) if self.at[w]) >= len(q):
                by_length[len(q)].append(i)
        out: dict[int, tuple[float, int]] = {}
        for m, some in by_length.items():
            step = max(1, CELLS // max(len(self.words), m * min(len(some), 64)))
            for lo in range(0, len(some), step):
                self._near(m, some[lo : lo + step], quotes, own, least, first, autojunk, out)
        return out

    def _near(self, m: int, some: list[int], quotes, own, least: float, first: bool, autojunk: bool, out: dict) -> None:
        vocabulary = {w: k for k, w in enumerate({w for i in some for w in quotes[i]}, 1)}
        holds = np.zeros((len(some), len(vocabulary) + 1), np.uint8 if m < 256 else np.int32)
        for r, i in enumerate(some):
            holds[r, [vocabulary[w] for w in quotes[i]]] = 1
        ids = np.zeros(len(self.words), np.int32)
        for w, k in vocabulary.items():
            ids[self.at[w]] = k
        held = _sums(holds[:, ids], m)
        row, start = np.nonzero(held >= (m + 1) // 2)
        if not len(row):
            return
        count = self._counts()
        if self._ends is None:
            self._ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)))
        mine = np.array([len(own[i]) for i in some])
        size = np.array([sum(map(len, quotes[i])) + m - 1 for i in some])[row]
        length = self._ends[start + m] - self._ends[start] - 1
        most = 2.0 * np.minimum(size, length) / (size + length)
        ok = (count[start + m] - count[start] == mine[row]) & (most >= least)
        row, start, most = row[ok], start[ok], most[ok]
        # The likeliest run first: the others need only reach its ratio.
        order = np.lexsort((-start, -held[row, start].astype(np.int64), row))
        match, last, done = None, -1, False
        for r, s, bound in zip(row[order].tolist(), start[order].tolist(), most[order].tolist()):
            if r != last:
                i, last, done, match = some[r], r, False, None
                q = quotes[i]
                words, best, text = set(q), (least, -1), " ".join(q)
            if done or bound < best[0]:
                continue
            run = self.words[s : s + m]
            if 2 * len(words.intersection(run)) < m:
                continue
            line = " ".join(run)
            if own[i] and numbers(line) != own[i]:
                continue
            if match is None:
                match = _Match(text, autojunk)
            found = (match.ratio(line, best[0]), s)
            if found >= best:
                out[i] = best = found
                done = first


class _Match:
    """The ratio of a sequence matcher's matches to a quote, b."""

    def __init__(self, b: str, autojunk: bool):
        self.b, self.autojunk, self.full = b, autojunk, None

    def ratio(self, a: str, least: float) -> float:
        """0 where its quick bound stays below ``least``."""
        b = self.b
        if len(b) < 200 and _one_gap(a, b):
            return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
        if self.full is None:
            self.full = difflib.SequenceMatcher(None, "", b, self.autojunk)
        self.full.set_seq1(a)
        return self.full.ratio() if self.full.quick_ratio() >= least else 0.0


def _one_gap(a: str, b: str) -> bool:
    """Is the shorter one the longer one with a piece cut out, and does the matcher see it so? It takes the longest common piece
    first, of equals the first. With no piece longer than the common head, which is no shorter than the common tail, that is the
    head, and the tail is all that the rest has in common."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = n - head
    if tail > head or tail and not b.endswith(a[head:]):
        return False
    return not any(a[i : i + head + 1] in b for i in range(tail))


def _sums(x: np.ndarray, m: int) -> np.ndarray:
    """Sums of m columns in a row, from each column on; in powers of two."""
    total, out, at, size = x.shape[1] - m + 1, None, 0, 1
    while True:
        if m & size:
            part = x[:, at : at + total]
            out, at = part if out is None else out + part, at + size
        if 2 * size > m:
            return out
        x = x[:, : x.shape[1] - size] + x[:, size:]
        size *= 2


def segment_of(counts: list[int]):
    """From a word's position to its segment, given each segment's number of words."""
    ends = list(accumulate(counts))
    return lambda pos: bisect_right(ends, pos)
