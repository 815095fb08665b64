"""Pairs of fingerprints within a Hamming radius, by vantage points.

A set is split by its distances to a vantage point: a pair whose two distances
to it differ by more than the radius cannot be within the radius (triangle
bound), so the inner and the outer part are searched by themselves, and against
each other only where they overlap the boundary.
"""

from __future__ import annotations

import numpy as np

#: Most points that are compared without a vantage point.
LEAF = 64


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int16)


def _to(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).sum(axis=1, dtype=np.int16)


def close_pairs(points: np.ndarray, r: int, side: np.ndarray | None = None, tests: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i before j in no special order, of the rows of ``points`` (n x words, uint64) within ``r``; each pair once.

    With a ``side`` of 1 or 2 for each point (0: no sides) only pairs across the
    sides are looked for. ``tests`` gathers the number of distances computed.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    work: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    if side is not None and len(side) and side[0]:
        work = [(np.flatnonzero(side == 1), np.flatnonzero(side == 2))]
    while work:
        a, b = work.pop()
        if b is None:
            if tests is not None:
                tests.append(len(a) * (len(a) - 1) // 2 if len(a) <= LEAF else len(a))
            if len(a) <= LEAF:
                i, j = np.nonzero(np.triu(_dist(points[a], points[a]) <= r, 1))
                left.append(a[i])
                right.append(a[j])
                continue
            d = _to(points[a], points[a[len(a) // 2]])
            mu = np.median(d)
            inner = d <= mu
            if inner.all():
                mu = d.max() - 1
                inner = d <= mu
            if inner.all() or not inner.any():  # all at one distance: nothing to prune, so halves
                half = len(a) // 2
                work += [(a[:half], None), (a[half:], None), (a[:half], a[half:])]
                continue
            work += [(a[inner], None), (a[~inner], None), (a[inner & (d >= d[~inner].min() - r)], a[~inner & (d <= d[inner].max() + r)])]
        elif len(a) and len(b):
            if tests is not None:
                tests.append(len(a) * len(b) if len(a) * len(b) <= LEAF * LEAF else len(a) + len(b))
            if len(a) * len(b) <= LEAF * LEAF:
                i, j = np.nonzero(_dist(points[a], points[b]) <= r)
                left.append(a[i])
                right.append(b[j])
                continue
            big, small = (a, b) if len(a) >= len(b) else (b, a)
            vantage = points[big[len(big) // 2]]
            d, e = _to(points[big], vantage), _to(points[small], vantage)
            mu = np.median(d)
            inner = d <= mu
            if inner.all() or not inner.any():
                half = len(big) // 2
                work += [(big[:half], small), (big[half:], small)]
                continue
            for part in (inner, ~inner):
                low, high = d[part].min() - r, d[part].max() + r
                work.append((big[part], small[(e >= low) & (e <= high)]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))
