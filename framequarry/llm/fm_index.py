"""FM-index over integer sequences: suffix array, BWT and a bit-packed wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative integers by prefix doubling; a suffix sorts before its extensions."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    return order


class WaveletMatrix:
    """Descents for rank(symbol, position) over a sequence, in about one bit per symbol and level plus block counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.n = bits, len(seq)
        self.words, self.blocks, self.zeros = [], [], []
        seq = seq.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.blocks.append(counts.astype(np.uint32))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position of a level."""
        block, within = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][block] & ((np.uint64(1) << within) - np.uint64(1))
        return self.blocks[level][block].astype(np.int64) + np.bitwise_count(low)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of position ``at[i]`` in the lowest level, on the path of ``symbol[i]``."""
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones = self.ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of ``text``, whose symbols are 0 .. sigma-1; backward search gives suffix-array ranges."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.sa = suffix_array(text)
        self.n = len(text)
        last = text[self.sa - 1]  # the text is taken as a circle: its last symbol is a separator
        self.wavelet = WaveletMatrix(last, max(1, int(sigma - 1).bit_length()))
        less = np.zeros(sigma, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma)[:-1], out=less[1:])
        # rank(c, i) = descend(c, i) - descend(c, 0); the second part is the same for all searches of a symbol
        symbols = np.arange(sigma)
        self.offset = less - self.wavelet.descend(symbols, np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with ``symbol[i]`` and go on with one of the range i: a step of backward search."""
        m = len(symbol)
        c = np.tile(symbol, 2)
        ends = self.offset[c] + self.wavelet.descend(c, np.concatenate([lo, hi]))
        return ends[:m], ends[m:]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of ``patterns`` (all of one length), empty where there is none."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for t in range(patterns.shape[1] - 1, -1, -1):
            lo, hi = self.extend(patterns[:, t], lo, hi)
        return lo, hi
