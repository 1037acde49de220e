"""Order statistics of sliding windows.

The places of a series are indexed once by the binary digits of their values' ranks (one count per place and digit); the k-th smallest
value of any run of places is then one step per digit, for all windows together. No window is copied or sorted.
"""
from __future__ import annotations

import numpy as np


class Ranks:
    """k-th smallest value of any run [lo, hi) of ``values``."""

    def __init__(self, values: np.ndarray):
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.digits = max(1, int(len(self.sorted) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for d in reversed(range(self.digits)):
            bit = (rank >> d) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """``k`` counts from 0 and lies below hi - lo."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for level, zero in enumerate(self.zeros):
            a, b = zero[lo], zero[hi]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            rank |= one.astype(np.int64) << (self.digits - 1 - level)
            lo, hi = np.where(one, zero[-1] + lo - a, a), np.where(one, zero[-1] + hi - b, b)
        return self.sorted[rank]

    def up_to(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Values in each run that are at most ``limit``."""
        end = np.searchsorted(self.sorted, limit, "right")
        full = end >= len(self.sorted)
        rank, got, a0, b0 = np.where(full, 0, end), np.zeros(len(lo), np.int64), lo.copy(), hi.copy()
        for level, zero in enumerate(self.zeros):
            one = (rank >> (self.digits - 1 - level)) & 1 == 1
            a, b = zero[a0], zero[b0]
            got += np.where(one, b - a, 0)
            a0, b0 = np.where(one, zero[-1] + a0 - a, a), np.where(one, zero[-1] + b0 - b, b)
        return np.where(full, hi - lo, got)


def _middle(kth, n: np.ndarray) -> np.ndarray:
    return (kth((n - 1) // 2) + kth(n // 2)) / 2


def median_and_deviation(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of each non-empty run, and the median distance from it.

    Distances are two sorted rows, the values up to the median backwards and those above it forwards; the k-th
    smallest of both is found by halving how many come from the first.
    """
    ranks, n = Ranks(values), hi - lo
    median = _middle(lambda k: ranks.kth(lo, hi, k), n)
    low = ranks.up_to(lo, hi, median)

    def near(i):
        """Distance of the i-th value at or below the median, nearest first; infinite beyond the last."""
        return np.where(i < low, median - ranks.kth(lo, hi, np.clip(low - 1 - i, 0, n - 1)), np.inf)

    def above(i):
        return np.where(i < n - low, ranks.kth(lo, hi, np.clip(low + i, 0, n - 1)) - median, np.inf)

    def distance(k):
        least, most = np.maximum(0, k - (n - low)), np.minimum(k, low)  # how many of the k smaller ones lie at or below
        while (least < most).any():
            mid = (least + most) // 2
            more = near(mid) < above(k - 1 - mid)
            least, most = np.where((least < most) & more, mid + 1, least), np.where((least < most) & ~more, mid, most)
        return np.minimum(near(least), above(k - least))

    return median, _middle(distance, n)
