"""Peaks of many curves at once, in time linear but for a logarithm.

The curves of a batch lie one after another with a wall of infinite height between them, so no question reaches across. Two
tables, of the least and the greatest value of every window whose width is a power of two, answer for all peaks at once:

* which sample to either side is the first that is higher (halving steps over windows that aren't),
* what the least value on the way there is (two overlapping windows), and so the prominence,
* which sample to either side is the first at or below half prominence, and so the width.
"""

from __future__ import annotations

import numpy as np

#: Samples of curves that are worked on together; a longer curve is worked on alone.
TOGETHER = 1 << 18


def _windows(y: np.ndarray, longest: int, pick: np.ufunc) -> list[np.ndarray]:
    """tables[k][i]: `pick` of y[i .. i + 2^k - 1]."""
    tables = [y]
    while 2 << len(tables) - 1 <= longest and 2 << len(tables) - 1 <= len(y):
        half = 1 << len(tables) - 1
        tables.append(pick(tables[-1][:-half], tables[-1][half:]))
    return tables


def _first(tables: list[np.ndarray], at: np.ndarray, step: int, passes) -> np.ndarray:
    """From `at`, exclusive, to the left (step -1) or right (1): the first place whose value doesn't pass."""
    reach = at.copy()  # everything between at and reach passes; reach itself is exclusive on the left, inclusive before it
    for k in range(len(tables) - 1, -1, -1):
        table, size = tables[k], 1 << k
        begin = reach - size if step < 0 else reach + 1
        inside = (begin >= 0) & (begin < len(table))
        ok = inside & passes(table[np.where(inside, begin, 0)])
        reach = np.where(ok, reach + step * size, reach)
    return reach + step


def _least(tables: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value of [begin, end), which isn't empty and no wider than the widest table covers twice."""
    level = np.minimum(np.frexp((end - begin).astype(float))[1] - 1, len(tables) - 1)
    out = np.empty(len(begin))
    for k in np.unique(level):
        i = np.flatnonzero(level == k)
        table = tables[k]
        out[i] = np.minimum(table[begin[i]], table[end[i] - (1 << int(k))])
    return out


def _tops(y: np.ndarray) -> np.ndarray:
    """Middles of plateaus that are higher than both neighbours."""
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    last = np.r_[first[1:], len(y)] - 1
    v = y[first]
    higher = np.r_[False, (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]), False] if len(v) > 2 else np.zeros(len(v), bool)
    return ((first + last) // 2)[higher & np.isfinite(v)]


def _crossing(y: np.ndarray, low: list[np.ndarray], at: np.ndarray, start: np.ndarray, level: np.ndarray, step: int) -> np.ndarray:
    """Where the curve, read linearly, falls to a level on the way from a peak, counted from the curve's own start."""
    i = _first(low, at, step, lambda v: v > level)
    below, above = y[i], y[i - step]
    with np.errstate(invalid="ignore", divide="ignore"):
        back = np.where(below < level, (level - below) / (above - below), 0.0)
    return i - start - step * back


def _found(curves: list[np.ndarray], prominence: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in curves])
    wall = [np.array([np.inf])]
    y = np.concatenate([x for c in curves for x in (wall[0], c)] + wall)
    start = np.cumsum(np.r_[1, sizes[:-1] + 1])
    at = _tops(y)
    owner = np.searchsorted(start, at, "right") - 1
    low, high = _windows(y, int(sizes.max()), np.minimum), _windows(y, int(sizes.max()), np.maximum)
    left, right = (_first(high, at, step, lambda v: v <= y[at]) for step in (-1, 1))
    height = y[at] - np.maximum(_least(low, left + 1, at + 1), _least(low, at, right))
    keep = height >= prominence[owner]
    at, owner, level = at[keep], owner[keep], y[at[keep]] - height[keep] / 2
    right, left = (_crossing(y, low, at, start[owner], level, step) for step in (1, -1))
    wide = right - left
    keep = ~(wide < width[owner])
    return owner[keep], (at - start[owner])[keep], wide[keep]


def find_all(curves: list[np.ndarray], prominence: np.ndarray, width: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(curve, place, width in samples) of the peaks of at least a curve's prominence and, if given, width, in order.

    Prominence is the height over the higher of the least values to either side, up to a higher sample or the end; width is
    taken at half prominence. A value that isn't a number ends a side; flat ends are no peaks."""
    prominence = np.broadcast_to(np.asarray(prominence, float), (len(curves),))
    width = np.broadcast_to(np.asarray(-np.inf if width is None else width, float), (len(curves),))
    parts, begin, size = [], 0, 0
    for k, c in enumerate(curves):
        size += len(c) + 1
        if size >= TOGETHER or k == len(curves) - 1:
            own, at, wide = _found(curves[begin : k + 1], prominence[begin : k + 1], width[begin : k + 1])
            parts.append((own + begin, at, wide))
            begin, size = k + 1, 0
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    own, at, wide = (np.concatenate(x) for x in zip(*parts, strict=True))
    return own, at, wide
