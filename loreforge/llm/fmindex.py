"""FM-index over sequences of small numbers: suffix order, wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by doubling the compared length until ranks differ."""
    n, step = len(rank), 1
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while n > 1:
        behind = np.zeros(n, np.int64)
        behind[:-step] = rank[step:] + 1
        key = rank * (rank.max() + 2) + behind
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    return order


class Wavelet:
    """Wavelet matrix: how often a symbol occurs before a position, for many (symbol, position) pairs at once."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.zeros, self.split = width, [], []
        for level in range(width - 1, -1, -1):
            bit = (symbols >> level) & 1
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros(len(symbol), np.int64)
        at = at.astype(np.int64)
        for i, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = ((symbol >> (self.width - 1 - i)) & 1).astype(bool)
            z, s = zeros[at], zeros[start]
            at, start = np.where(one, split + at - z, z), np.where(one, split + start - s, s)
        return at - start


class FMIndex:
    """Index of runs of symbols 1..m; a run never continues into the next.

    ``text`` holds the runs, each closed by a 0.  Zeros count as different from
    one another, so suffixes are ordered by the rest of their run alone.  The
    position of every ``sample``-th symbol of a run, its first included, is kept;
    others are found by stepping back to one of those.
    """

    def __init__(self, text: np.ndarray, width: int, sample: int = 8):
        n = len(text)
        closing = text == 0
        ends = np.flatnonzero(closing)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        order = suffix_order(rank)
        last = np.empty(n, np.int64)
        last[:] = text[order - 1]  # the closing 0 of the whole text stands before its first symbol
        self.tree = Wavelet(last, width)
        self.last = last
        counts = np.bincount(text, minlength=(1 << width) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        begin = np.concatenate([[0], ends[:-1] + 1])
        offset = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        self.kept = (offset % sample == 0)[order]
        self.place = np.cumsum(self.kept) - 1
        self.samples = order[self.kept]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of the suffixes that start with each pattern (rows of ``patterns``, right-padded)."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back].astype(np.int64)
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.empty(len(rows), np.int64)
        rows, back, where = rows.copy(), 0, np.arange(len(rows))
        while len(rows):
            done = self.kept[rows]
            out[where[done]] = self.samples[self.place[rows[done]]] + back
            rows, where = rows[~done], where[~done]
            symbol = self.last[rows]
            rows = self.first[symbol] + self.tree.rank(symbol, rows)
            back += 1
        return out
