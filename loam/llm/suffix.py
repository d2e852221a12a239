"""Suffix arrays, rank structures and searches over integer sequences, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of x in order, by prefix doubling; each round sorts only suffixes that are not yet told apart."""
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    sa = np.argsort(x, kind="stable")
    slot = np.arange(n, dtype=np.int64)
    rank = np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = x[sa[1:]] != x[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(fresh, slot, 0))
    last = np.append(fresh[1:], True)
    open_ = np.flatnonzero(~(fresh & last))
    k = 1
    while len(open_):
        p = sa[open_]
        first = rank[p]
        nxt = np.where(p + k < n, rank[np.minimum(p + k, n - 1)] + 1, 0)
        order = np.argsort(first * (n + 1) + nxt, kind="stable") if n < 3_000_000_000 else np.lexsort((nxt, first))
        p, first, nxt = p[order], first[order], nxt[order]
        sa[open_] = p
        fresh = np.ones(len(p), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (nxt[1:] != nxt[:-1])
        rank[p] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        k *= 2
    return sa


class BitVector:
    """Bits with constant-time rank: a running count for each word of 64."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """A levelwise wavelet tree (as a matrix): one bit vector for each bit of the symbols, highest first."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        for k in range(self.bits - 1, -1, -1):
            bit = (x >> k) & 1
            one = bit.astype(bool)
            self.levels.append((BitVector(bit), int(len(x) - one.sum())))
            x = np.concatenate([x[~one], x[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i places."""
        start = np.zeros(len(i), np.int64)
        end = i.astype(np.int64)
        for k, (b, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            s, e = b.rank1(start), b.rank1(end)
            start = np.where(one, zeros + s, start - s)
            end = np.where(one, zeros + e, end - e)
        return end - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before that place."""
        symbol = np.zeros(len(i), np.int64)
        start, at = np.zeros(len(i), np.int64), i.astype(np.int64)
        for b, zeros in self.levels:
            one = b.get(at).astype(bool)
            symbol = symbol * 2 + one
            s, e = b.rank1(start), b.rank1(at)
            start = np.where(one, zeros + s, start - s)
            at = np.where(one, zeros + e, at - e)
        return symbol, at - start


class FMIndex:
    """Backward search and location over a sequence of symbols 1 to symbols-1; 0 ends it."""

    def __init__(self, x: np.ndarray, symbols: int, sample: int = 16):
        x = np.append(x.astype(np.int64), 0)
        n = len(x)
        sa = suffix_array(x)
        bwt = x[sa - 1]
        self.n, self.symbols = n, symbols
        self.tree = WaveletTree(bwt, symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])
        marked = (sa % sample == 0) | (bwt == 0)  # a separator's rows are never walked through
        self.marked, self.samples = BitVector(marked), sa[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [start, end) of the suffixes that begin with each phrase (rows of phrases, padded at the end)."""
        start = np.zeros(len(phrases), np.int64)
        end = np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (start < end))
            c = phrases[live, j]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([start[live], end[live]]))
            start[live] = self.less[c] + both[: len(live)]
            end[live] = self.less[c] + both[len(live) :]
        return start, np.maximum(start, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix, by walking back to a sampled one."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(self.marked.get(at) == 0)
        while len(left):
            symbol, before = self.tree.access_rank(at[left])
            at[left] = self.less[symbol] + before
            steps[left] += 1
            left = left[self.marked.get(at[left]) == 0]
        return self.samples[self.marked.rank1(at)] + steps
