"""An FM-index over integer sequences: suffix order by doubling, ranks by a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """rank(c, i): how often symbol c stands before place i; one packed bit vector with block counts per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit) & 1 == 1
            packed = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]])
            self.levels.append((bit, packed, counts, len(bits) - int(bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        alphabet = np.arange(n_symbols)
        self.origin = self._place(alphabet, np.zeros(n_symbols, np.int64))

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            block = i >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._place(c, i) - self.origin[c]


class FMIndex:
    """Sequences of word hashes, searchable backward; each carries an owner, and windows know their smallest one."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        lengths = np.array([len(s) for s in sequences])
        self.window, count = window, len(sequences)
        distinct, ids = np.unique(np.concatenate(sequences), return_inverse=True)
        self.codes = np.split(ids + 1, np.cumsum(lengths)[:-1])
        # Each sequence ends with a mark of its own, below all words, so no match reaches across.
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(int(lengths.sum()) + count, np.int64)
        mark = np.zeros(len(text), bool)
        mark[ends] = True
        text[mark], text[~mark] = np.arange(count), ids + count
        owner = np.repeat(owners, lengths + 1)
        order, same = self._sorted(text, window)
        coded = np.where(mark, 0, text - count + 1)
        self.wavelet = Wavelet(coded[order - 1], len(distinct) + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=len(distinct) + 1))])
        starts = np.flatnonzero(~same)
        self.group = np.cumsum(~same) - 1  # suffixes that agree in their first `window` symbols
        self.lo, self.hi = starts, np.append(starts[1:], len(text))
        self.least = np.minimum.reduceat(owner[order], starts)

    @staticmethod
    def _sorted(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix order, and which suffixes agree with the one before in `window` symbols."""
        n, step, wide = len(text), 1, 1 << (window.bit_length() - 1)
        rank, at = text, None
        while True:
            if step == wide:
                at = rank
            ahead = np.full(n, -1, np.int64)
            ahead[: n - step] = rank[step:] if step < n else []
            key = rank * (n + 1) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 and at is not None:
                break
        far = order + window - wide
        inside = far < n
        half = np.where(inside, at[np.minimum(far, n - 1)], -1 - np.arange(n))
        same = np.zeros(n, bool)
        same[1:] = (at[order][1:] == at[order][:-1]) & (half[1:] == half[:-1])
        return order, same

    def smallest_owners(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """For every window of each sequence (in this index's codes), the smallest owner of an equal one; searched backward in step."""
        longest_first = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        lengths = np.array([len(codes[i]) for i in longest_first])
        table = np.zeros((len(codes), int(lengths[0])), np.int64)
        for row, i in enumerate(longest_first):
            table[row, : lengths[row]] = codes[i][::-1]
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), self.below[-1])
        found = np.zeros((len(codes), int(lengths[0])), np.int64)
        for depth in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -depth, "left"))
            c = table[:live, depth]
            lo, hi = self.below[c] + self.wavelet.rank(c, lo[:live]), self.below[c] + self.wavelet.rank(c, hi[:live])
            if depth + 1 >= self.window:  # matches are as long as a window: widen to all suffixes that share it
                group = self.group[lo]
                lo, hi = self.lo[group], self.hi[group]
                found[:live, depth] = self.least[group]
        out: list[np.ndarray] = [None] * len(codes)  # type: ignore[list-item]
        for row, i in enumerate(longest_first):
            out[i] = found[row, self.window - 1 : lengths[row]][::-1]
        return out
