"""An FM-index over a sequence of whole-number symbols, in vectorised numpy.

The text is a sequence of symbols 1 to ``sigma`` - 1; symbol 0 ends it. Parts: the suffix
array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix (one bit
vector with running counts a level), the symbol starts, and the suffix positions that are
multiples of ``every``.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: sort by the first 1, 2, 4, ... symbols; only unsettled suffixes are sorted again."""
    n = len(text)
    sa = np.argsort(text, kind="stable")
    key = text[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = starts  # of a group: the place where it begins
    step = 1
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa
        rows = sa[open_]
        ahead = rows + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        code = starts[open_] * (n + 1) + second
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        sa[open_] = rows  # groups keep their places, since the code begins with the group's
        first[open_] = np.concatenate([[True], code[1:] != code[:-1]])
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[rows] = starts[open_]
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        """``text``: symbols 1 to sigma - 1."""
        t = np.concatenate([np.asarray(text, dtype=np.int64), [0]])
        self.n = len(t)
        sa = suffix_array(t)
        bwt = t[sa - 1]  # of suffix 0: the end symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros, seq = [], [], bwt
        for k in range(self.bits - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        mark = sa % every == 0
        self.sampled = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(mark, out=self.sampled[1:])
        self.positions = sa[mark]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before ``at``."""
        low, high = np.zeros_like(at), at
        for ones, zeros, k in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            bit = (symbol >> k) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def step(self, rows: np.ndarray) -> np.ndarray:
        """From a suffix's row to the row of the suffix one symbol longer."""
        at, symbol = rows, np.zeros_like(rows)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return self.first[symbol] + self.rank(symbol, rows)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns of one length, one a row: their ranges of suffix rows."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a, b = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
            low[live], high[live] = a, b
            live = live[a < b]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions in the ranges, and the range of each."""
        size = high - low
        of = np.repeat(np.arange(len(low)), size)
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        out, walked, live = np.empty(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(live):
            known = self.sampled[rows + 1] - self.sampled[rows] == 1
            out[live[known]] = self.positions[self.sampled[rows[known]]] + walked
            live, rows = live[~known], rows[~known]
            rows = self.step(rows) if len(rows) else rows
            walked += 1
        return out, of
