"""Exact Jaccard of the sets of one place, in numpy."""

from __future__ import annotations

import numpy as np


def shared_members(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(holder, column, shared): the members that two sets at least hold, numbered by column, and how many of them each set has.

    `values` are the members of all sets one after the other, distinct within a set.
    """
    holder = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, holder = values[order], holder[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, dtype=bool)
    uses = np.diff(np.flatnonzero(fresh), append=len(values))
    kept = np.repeat(uses > 1, uses)
    uses = uses[uses > 1]
    holder = holder[kept]
    return holder, np.repeat(np.arange(len(uses), dtype=np.int64), uses), np.bincount(holder, minlength=len(sizes))


def ratio(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard of sets of sizes a and b with `both` members in common; it grows with `both`."""
    return both / (a + b - both)


def similar_pairs(
    values: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, columns: int = 1 << 13, pairs: int = 2048,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, jaccard): the allowed pairs of the sets numbered `left` and `right` whose Jaccard is `threshold` and more, exactly.

    Members of one set only can't be in an intersection, so what a set has besides bounds its pairs before any is compared. The others are columns
    of bitmaps, `columns` of them at a time.
    """
    holder, column, shared = shared_members(values, sizes)
    most = np.minimum(shared[left][:, None], shared[right][None, :])
    x, y = np.nonzero(allowed & (ratio(most, sizes[left][:, None], sizes[right][None, :]) >= threshold))
    a, b = left[x], right[y]
    both = np.zeros(len(a), dtype=np.int64)
    n_columns = int(column[-1]) + 1 if len(column) and len(a) else 0
    for low in range(0, n_columns, columns):
        start, end = np.searchsorted(column, [low, low + columns])
        spots = np.zeros((len(sizes), -(-min(columns, n_columns - low) // 64) * 64), dtype=bool)
        spots[holder[start:end], column[start:end] - low] = True
        bits = np.packbits(spots, axis=1).view(np.uint64)
        del spots
        for k in range(0, len(a), pairs):
            both[k : k + pairs] += np.bitwise_count(bits[a[k : k + pairs]] & bits[b[k : k + pairs]]).sum(axis=1, dtype=np.int64)
    score = ratio(both, sizes[a], sizes[b])
    linked = score >= threshold
    return a[linked], b[linked], score[linked]


def common_before(groups: np.ndarray, sizes: np.ndarray, group: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix of `left` by `right`: do two members share a lesser group than `group`? `groups` are those of all members one after the other."""
    holder = np.repeat(np.arange(len(sizes)), sizes)
    lesser = groups < group
    names, column = np.unique(groups[lesser], return_inverse=True)
    found = np.zeros((len(left), len(right)), dtype=bool)
    for low in range(0, len(names), 1024):
        here = (column >= low) & (column < low + 1024)
        spots = np.zeros((len(sizes), min(1024, len(names) - low)), dtype=np.float32)
        spots[holder[lesser][here], column[here] - low] = 1
        found |= spots[left] @ spots[right].T > 0
    return found
