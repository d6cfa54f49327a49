"""FM-index over word ids: suffix array, Burrows-Wheeler transform and a wavelet matrix.

All searches run for many patterns at once as array operations. The wavelet matrix stores one bit
of each symbol a level with running counts of ones, so a rank query costs two look-ups a level.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, h = len(text), 1
    order = np.argsort(rank, kind="stable")
    while h < depth and n:
        nxt = np.full(n, -1, np.int64)
        nxt[: max(0, n - h)] = rank[h:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        step = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            break
        h *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in any prefix."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        # where each symbol's block begins in the last level
        at = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin[now[at]] = at

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``upto`` (arrays of equal length)."""
        at = upto
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]


class FmIndex:
    """Backward search over a text of symbols 0..n_symbols-1; 0 is the separator and matches nothing."""

    def __init__(self, text: np.ndarray, n_symbols: int, depth: int):
        self.text, self.n = text, len(text)
        self.order = suffix_order(text, depth)
        self.bwt = text[self.order - 1]  # the last symbol comes before the first suffix
        self.tree = WaveletMatrix(self.bwt, n_symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:-1]

    def matching(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to ``length``: how far back from each end the text occurs elsewhere too.

        Returns (reached, low, high): the number of symbols, and the suffix interval of the
        pattern of that length. An end whose pattern has become unique is searched no further.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        reached, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for back in range(1, length + 1):
            symbol = self.text[ends[live] - back]
            down = self.before[symbol] + self.tree.rank(symbol, low[live])
            up = self.before[symbol] + self.tree.rank(symbol, high[live])
            again = (symbol > 0) & (up - down > 1)
            live, down, up = live[again], down[again], up[again]
            low[live], high[live], reached[live] = down, up, back
            if not len(live):
                break
        return reached, low, high
