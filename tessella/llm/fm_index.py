"""FM-index over integer sequences: a bit-packed wavelet matrix of the transformed text.

Sequences are joined by the symbol 0. Suffixes are ordered by their first ``depth`` symbols, which
is all that a backward search of up to ``depth`` steps needs: equal beginnings may come in any order.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of integers in one bit per level and symbol."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(int(len(bits) - bits.sum()))
            current = np.concatenate([current[~bits], current[bits]])
        self.base = self._descend(np.arange(symbols, dtype=np.int64), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            below = (np.uint64(1) << bit) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & below)
            place = np.where(symbol >> level & 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``place``, for many pairs at once."""
        return self._descend(symbol, place) - self.base[symbol]


class FMIndex:
    """Index of sequences given as one array ``text`` in which 0 follows every sequence."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text = text.astype(np.int64)
        self.symbols = int(self.text.max(initial=0)) + 1
        rank, span = self.text, 1
        order = np.argsort(rank)
        while span < depth:
            after = np.zeros_like(rank)
            after[:-span] = rank[span:] if span < len(rank) else 0
            key = rank * (int(rank.max(initial=0)) + 1) + after
            order = np.argsort(key)
            in_order = key[order]
            new = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
            rank = np.empty_like(rank)
            rank[order] = new
            span *= 2
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.symbols))])
        self.matrix = WaveletMatrix(self.text[order - 1], self.symbols)

    def search(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with text[start : start + length], by backward search.

        A search ends early, with a range of one, as soon as its suffix occurs only once.
        """
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = np.arange(len(starts))
        symbol = self.text[starts + length - 1]
        a, b = self.first[symbol], self.first[symbol + 1]
        for back in range(2, length + 1):
            low[active], high[active] = a, b
            more = b - a > 1
            active, a, b = active[more], a[more], b[more]
            if not len(active):
                break
            symbol = self.text[starts[active] + length - back]
            a = self.first[symbol] + self.matrix.rank(symbol, a)
            b = self.first[symbol] + self.matrix.rank(symbol, b)
        low[active], high[active] = a, b
        return low, high
