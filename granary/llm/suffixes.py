"""Suffix order of a block of strings, and longest previous and next factors from it."""

from __future__ import annotations

import numpy as np


class SuffixOrder:
    """Order of some suffixes of a block by their first `length` bytes, by prefix doubling.

    block: uint8, the strings one after the other; at: starts of the suffixes, rising; end: where each one's string
    ends, `length` bytes after its start or later. Suffixes that agree in `length` bytes stand in the order of their
    starts.
    """

    def __init__(self, block: np.ndarray, at: np.ndarray, end: np.ndarray, length: int) -> None:
        self.n, self.at, self.end, self.length = len(block), at, end, length
        first = min(8, 1 << (length.bit_length() - 1))
        padded = np.concatenate([block, np.zeros(8, np.uint8)])
        key = np.zeros(self.n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + self.n]
        self.key = key
        #: (k, ranks of all positions by their first k bytes); past the block's end the rank is 0
        self.levels = [(first, self._ranks(key >> np.uint64(8 * (8 - first))))]
        while 2 * self.levels[-1][0] <= length:
            k, rank = self.levels[-1]
            self.levels.append((2 * k, self._ranks(self._joined(rank, np.arange(self.n), k))))
        k, rank = self.levels[-1]
        self.whole = self._joined(rank, at, length - k)  # k <= length < 2 * k: two overlapping halves
        self.order = np.argsort(self.whole, kind="stable")

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        rank = np.zeros(self.n + 1, np.uint32)
        rank[:-1] = np.unique(key, return_inverse=True)[1] + 1
        return rank

    def _joined(self, rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        return (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + step, self.n)]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y (indices into `at`) have in common, within their strings; 0 where one is -1."""
        known = (x >= 0) & (y >= 0)
        a, b = self.at[x[known]], self.at[y[known]]
        got = np.zeros(len(a), np.int64)
        for k, rank in [self.levels[-1], *self.levels[::-1]]:
            same = rank[np.minimum(a + got, self.n)] == rank[np.minimum(b + got, self.n)]
            got += k * same
        differ = self.key[np.minimum(a + got, self.n - 1)] ^ self.key[np.minimum(b + got, self.n - 1)]
        for j in range(1, 8):
            got += (differ >> np.uint64(8 * (8 - j))) == 0
        out = np.zeros(len(x), np.int64)
        out[known] = np.minimum(got, np.minimum(self.end[x[known]] - a, self.end[y[known]] - b))
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Longest previous and longest next factor of each suffix, exact up to `length` bytes at least.

        The suffix that agrees longest among those of earlier starts is the nearest one before or after in suffix
        order whose start is smaller; among those of later starts, the nearest whose start is greater.
        """
        out = []
        for place in (self.order, -self.order):
            longest = np.zeros(len(self.at), np.int64)
            for near in (nearest_smaller(place), len(place) - 1 - nearest_smaller(place[::-1])[::-1]):
                found = np.where((near >= 0) & (near < len(place)), self.order[np.clip(near, 0, max(0, len(place) - 1))], -1) if len(place) else near
                longest[self.order] = np.maximum(longest[self.order], self.common(self.order, found))
            out.append(longest)
        return out[0], out[1]


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; values differ.

    All places jump at once over the stretches that their candidates have already skipped.
    """
    near = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        open_ = open_[x[near[open_]] > x[open_]]
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
    return near
