"""Minimum-distance one-to-one assignment of two point sets in the plane."""
from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

NEAR = 12                   # nearest partners a point is listed with at first
BLOCK = 1 << 20             # distances held at once


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[list, list, np.ndarray]:
    """For each point of a its k nearest of b with their distances, and the distance that
    all others of b reach at least."""
    who, far = [], []
    radius = np.full(len(a), np.inf)
    step = max(1, BLOCK // max(len(b), 1))
    for lo in range(0, len(a), step):
        d = np.hypot(a[lo:lo + step, None, 0] - b[None, :, 0], a[lo:lo + step, None, 1] - b[None, :, 1])
        if k < len(b):
            near = np.argpartition(d, k, axis=1)
            radius[lo:lo + step] = np.take_along_axis(d, near[:, k:k + 1], 1)[:, 0]
            near = near[:, :k]
        else:
            near = np.broadcast_to(np.arange(len(b)), d.shape)
        who += near.tolist()
        far += np.take_along_axis(d, near, 1).tolist()
    return who, far, radius


def assign_points(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of an assignment of min(len(a), len(b)) pairs with the least sum of
    distances, by place in a. Shortest augmenting paths with dual prices over near pairs. A
    pair that is not listed costs at least the radius of its point's list, and prices of b are
    never positive, so radius - price of the point bounds its reduced cost: before a path gets
    as long as that, the point's other pairs are looked at. The result is that of all pairs."""
    if len(a) > len(b):
        j, i = assign_points(b, a)
        o = np.argsort(i)
        return i[o], j[o]
    a, b = np.asarray(a, float).reshape(-1, 2), np.asarray(b, float).reshape(-1, 2)
    n, m = len(a), len(b)
    near, cost, radius = _nearest(a, b, NEAR)
    radius = radius.tolist()
    u, v = [0.0] * n, np.zeros(m)
    row_of, col_of, free = [-1] * m, [-1] * n, np.ones(m, bool)
    dist, via = np.full(m, np.inf), [-1] * m
    for start in range(n):
        heap: list = []                       # (distance, column), or (bound, -1 - row)
        reach, settled, touched = {start: 0.0}, {}, []
        best, row = np.inf, start             # length of a path that is known; row to scan
        while True:
            if row >= 0:
                base = reach[row] - u[row]
                for j, c in zip(near[row], cost[row]):
                    d = base + c - v[j]
                    if d <= best and d < dist[j]:
                        dist[j], via[j] = d, row
                        touched.append(j)
                        heappush(heap, (d, j))
                        if row_of[j] < 0:
                            best = d
                if base + radius[row] <= best and radius[row] < np.inf:
                    heappush(heap, (base + radius[row], -1 - row))
            d, j = heappop(heap)
            row = -1
            if j < 0:                         # the other pairs of this row
                i = -1 - j
                alt = np.hypot(a[i, 0] - b[:, 0], a[i, 1] - b[:, 1]) + (reach[i] - u[i]) - v
                open_ = alt[free]
                best = min(best, float(open_.min()))
                more = np.flatnonzero((alt <= best) & (alt < dist))
                dist[more] = alt[more]
                for j, d in zip(more.tolist(), alt[more].tolist()):
                    via[j] = i
                    heappush(heap, (d, j))
                touched += more.tolist()
            elif j not in settled:
                settled[j] = d
                dist[j] = -np.inf             # no shorter way to it
                if row_of[j] < 0:
                    break
                row = row_of[j]
                reach[row] = d
        for i, r in reach.items():
            u[i] += d - r
        for k, r in settled.items():
            v[k] -= d - r
        dist[touched] = np.inf
        free[j] = False
        while True:
            i = via[j]
            row_of[j], col_of[i], j = i, j, col_of[i]
            if i == start:
                break
    return np.arange(n), np.array(col_of, np.int64)
