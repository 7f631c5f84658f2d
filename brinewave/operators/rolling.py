"""Medians of many ranges of one sequence.

The ranges of a rolling frame overlap almost wholly, so ordering each of them costs rows
times frame. Here the values of the sequence are halved by rank again and again, from the
highest bit of the rank to the lowest, each half keeping the order of time. At every level
running counts say how many of a range went to the lower half, hence in which half its
wanted rank is and where the range lies in it. After as many levels as ranks have bits the
value is found: the cost of a range is the logarithm of the rows, whatever its width, and
all ranges go down together in numpy.
"""

from __future__ import annotations

import numpy as np


def ranked_in_ranges(values: np.ndarray, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ``rank``-th smallest (from 0) of ``values[first:last]``, for arrays of ranges none of which is too short."""
    order, place = np.unique(values, return_inverse=True)
    low, high, k = first.astype(np.int64), last.astype(np.int64), rank.astype(np.int64)
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(int(len(order) - 1).bit_length(), 0))):
        upper = (place >> bit & 1).astype(bool)
        lower_before = np.concatenate([[0], np.cumsum(~upper)])
        at_low, at_high = lower_before[low], lower_before[high]
        goes_up = k >= at_high - at_low
        k = k - np.where(goes_up, at_high - at_low, 0)
        base = lower_before[-1]
        low = np.where(goes_up, base + low - at_low, at_low)
        high = np.where(goes_up, base + high - at_high, at_high)
        found |= goes_up.astype(np.int64) << bit
        place = np.concatenate([place[~upper], place[upper]])
    return order[found]


def range_medians(values: np.ndarray, first: np.ndarray, last: np.ndarray, least: int = 1) -> np.ndarray:
    """Median of ``values[first:last]`` for each range, the mean of the middle two where their number is even.

    NaN is not a value; a range of fewer than ``least`` values has no median (NaN).
    """
    real = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(real)])
    first, last = before[first], before[last]
    n = last - first
    out = np.full(len(n), np.nan)
    enough = np.flatnonzero(n >= max(least, 1))
    if len(enough):
        a, b, n = first[enough], last[enough], n[enough]
        middle = ranked_in_ranges(values[real], np.tile(a, 2), np.tile(b, 2), np.concatenate([(n - 1) // 2, n // 2]))
        out[enough] = 0.5 * middle[:len(n)] + 0.5 * middle[len(n):]
    return out


def time_frames(at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last position of (t - half, t + half] around each of the sorted times."""
    return np.searchsorted(at, at - half, "right"), np.searchsorted(at, at + half, "right")
