"""An FM-index over a sequence of small integers, in NumPy.

The suffix array comes from prefix doubling on those suffixes whose rank isn't settled yet. The Burrows-Wheeler
transform lies in a wavelet matrix: per bit of the alphabet one vector of ones counted so far, so a rank is one look-up a
bit. Searches go backward, for all phrases at once. Every ``SAMPLE``-th text position keeps its suffix position; other
occurrences walk back to one.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; a suffix is less than its continuations."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(4, np.int64)])
    bits = int(padded.max()).bit_length()
    packed = 4 if bits * 4 <= 62 else 2 if bits * 2 <= 62 else 1
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = begin
    open_group = ~(new & np.append(new[1:], True))
    todo, width = order[open_group], packed
    while len(todo):
        old, following = rank[todo], rank[np.minimum(todo + width, n)]
        by = np.lexsort((following, old))
        todo, old, following = todo[by], old[by], following[by]
        at = np.arange(len(todo))
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        new = fresh | np.concatenate([[True], following[1:] != following[:-1]])
        rank[todo] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        todo = todo[~(new & np.append(new[1:], True))]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class WaveletMatrix:
    """Rank of any symbol before any place."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    """``text`` holds symbols from 1 to ``symbols`` - 1; 0 may separate parts."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        # A symbol of its own, less than all others, ends the text.
        ended = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_array(ended)
        self.transform = ended[order - 1]
        self.tree = WaveletMatrix(self.transform, symbols + 1)
        counts = np.bincount(ended, minlength=symbols + 1)
        self.before = np.cumsum(counts) - counts
        self.size = n
        sampled = order % SAMPLE == 0
        self.sampled = np.cumsum(sampled) - sampled
        self.is_sampled = sampled
        self.samples = order[sampled]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with ``symbol`` before those of low..high."""
        symbol = symbol + 1
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes ``at``."""
        at = at.copy()
        steps = np.zeros(len(at), np.int64)
        walking = np.flatnonzero(~self.is_sampled[at])
        while len(walking):
            symbol = self.transform[at[walking]]
            at[walking] = self.before[symbol] + self.tree.rank(symbol, at[walking])
            steps[walking] += 1
            walking = walking[~self.is_sampled[at[walking]]]
        return self.samples[self.sampled[at]] + steps

    def matches(self, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end in phrases, low, high) of all runs of ``length`` symbols of ``phrases`` that occur; 0 separates phrases."""
        end = np.flatnonzero(phrases)
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size + 1)
        for k in range(length):
            place = end - k
            live = place >= 0
            live[live] = phrases[place[live]] != 0
            end, low, high = end[live], low[live], high[live]
            low, high = self.extend(phrases[end - k], low, high)
            live = high > low
            end, low, high = end[live], low[live], high[live]
            if not len(end):
                break
        return end, low, high
