"""A compressed FM-index over word ids, and matching statistics by backward search, vectorised over many patterns.

The Burrows-Wheeler transform lies in a wavelet matrix of packed bits with a count per 64 of them. Suffixes are
sorted up to DEPTH words, which is more than any pattern here is long.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletMatrix:
    """Rank of a symbol before a place, by one packed bit row per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits, n = [], [], bits, len(symbols)
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int32)
            self.levels.append((words, counts))
            self.zeros.append(n - int(bit.sum()))
            symbols = np.r_[symbols[~bit], symbols[bit]]

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i stands among the symbols c after all levels; differences of it are ranks."""
        for (words, counts), zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            at = i >> 6
            ones = counts[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> b & 1, zeros + ones, i - ones)
        return i


def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array up to DEPTH symbols, and the common prefix of each suffix with the one before it (-1 at both ends)."""
    n, rank, ranks, d = len(text), np.unique(text, return_inverse=True)[1].astype(np.int64), [], 1
    while d <= DEPTH:
        ranks.append((d, np.r_[rank, np.full(d, -1)]))
        if d == DEPTH:
            break
        key = rank * (n + 1)
        key[:max(n - d, 0)] += rank[d:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        d *= 2
    sa = np.argsort(rank, kind="stable")
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for d, r in reversed(ranks):
        same = (a < n) & (b < n)
        same[same] = (r[a[same]] == r[b[same]]) & (a[same] + d <= n) & (b[same] + d <= n)
        lcp[same] += d
        a[same] += d
        b[same] += d
    return sa, np.r_[-1, lcp, -1]


def _before(v: np.ndarray) -> np.ndarray:
    """For each place the nearest one to the left with a smaller value, by pointer jumping; v[0] is the least."""
    out = np.arange(len(v)) - 1
    out[0] = 0
    todo = np.arange(1, len(v))
    while len(todo):
        todo = todo[v[out[todo]] >= v[todo]]
        todo = todo[out[todo] > 0]
        out[todo] = out[out[todo]]
    return out


class FMIndex:
    """Index of texts (arrays of word hashes), each standing for weight copies."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(t) + 1 for t in texts])
        flat = np.concatenate([np.r_[t, np.uint64(0)] for t in texts])
        ends = np.cumsum(sizes) - 1
        words = np.ones(len(flat), bool)
        words[ends] = False
        self.vocabulary, ids = np.unique(flat[words], return_inverse=True)
        symbols = np.zeros(len(flat), np.int64)  # 0 separates texts
        symbols[words] = ids + 1
        sa, self.lcp = _suffixes(symbols)
        self.left, self.right = _before(self.lcp), len(self.lcp) - 1 - _before(self.lcp[::-1])[::-1]
        self.n, self.first = len(flat), np.r_[0, np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1))]
        self.tree = WaveletMatrix(symbols[sa - 1], max(1, int(len(self.vocabulary)).bit_length()))
        c = np.arange(len(self.vocabulary) + 1)
        self.start = self.tree.place(c, np.zeros(len(c), np.int64))
        self.weight = np.r_[0, np.cumsum(np.repeat(weights, sizes)[sa])]

    def symbols(self, text: np.ndarray) -> np.ndarray:
        """Word hashes as symbols; -1 where the index lacks the word."""
        i = np.minimum(np.searchsorted(self.vocabulary, text), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[i] == text, i + 1, -1) if len(self.vocabulary) else np.full(len(text), -1)

    def matching_statistics(self, patterns: list[np.ndarray], least: int = 1) -> list[np.ndarray]:
        """Per place of each pattern the length of the longest match from there that stands at least `least` times in the texts."""
        size = np.array([len(p) for p in patterns])
        flat = self.symbols(np.concatenate(patterns)) if size.sum() else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        out = np.zeros(len(flat), np.int64)
        at, q = first + size - 1, np.zeros(len(size), np.int64)
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        lanes = np.flatnonzero(size > 0)
        while len(lanes):
            c = flat[at[lanes]]
            known = np.maximum(c, 0)
            new = self.first[known] + self.tree.place(np.r_[known, known], np.r_[lo[lanes], hi[lanes]]).reshape(2, -1) - self.start[known]
            ok = (c > 0) & (self.weight[new[1]] - self.weight[new[0]] >= least)
            grown, stuck = lanes[ok], lanes[~ok]
            lo[grown], hi[grown] = new[0][ok], new[1][ok]
            q[grown] += 1
            out[at[grown]] = q[grown]
            at[grown] -= 1
            lost = stuck[q[stuck] == 0]  # not even the word alone
            at[lost] -= 1
            up = stuck[q[stuck] > 0]  # to the parent: the longest shorter match
            a, b = self.lcp[lo[up]], self.lcp[hi[up]]
            depth = np.maximum(np.maximum(a, b), 0)
            lo[up] = np.where((a == depth) & (a > 0), self.left[lo[up]], lo[up])
            hi[up] = np.where((b == depth) & (b > 0), self.right[hi[up]], hi[up])
            lo[up], hi[up] = np.where(depth == 0, 0, lo[up]), np.where(depth == 0, self.n, hi[up])
            q[up] = depth
            lanes = lanes[at[lanes] >= first[lanes]]
        return np.split(out, np.cumsum(size)[:-1])
