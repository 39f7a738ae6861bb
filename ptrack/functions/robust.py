"""Weighted robust statistics of one point's neighbours."""
from __future__ import annotations

import numpy as np


def angle_diff(a, b):
    return (a - b + np.pi) % (2 * np.pi) - np.pi


def weighted_median(v, w):
    """First value, in ascending order, at which half the weight is reached."""
    o = np.argsort(v, kind="stable")
    c = np.cumsum(w[o])
    return v[o[np.searchsorted(c, 0.5 * c[-1])]]


def circular_medoid(a, w):
    """The angle with the least weighted sum of angular distances, to ten digits; the
    first one on ties."""
    # sorted prefix sums over the half circle ahead of and behind each angle
    o = np.argsort(a, kind="stable")
    s, ws = a[o], w[o]
    s3 = np.concatenate([s - 2 * np.pi, s, s + 2 * np.pi])
    w3 = np.tile(ws, 3)
    cw = np.concatenate([[0.0], np.cumsum(w3)])
    cs = np.concatenate([[0.0], np.cumsum(w3 * s3)])
    m = np.arange(len(a), 2 * len(a))
    hi, lo = np.searchsorted(s3, s + np.pi), np.searchsorted(s3, s - np.pi)
    ahead = (cs[hi] - cs[m]) - s * (cw[hi] - cw[m])
    behind = s * (cw[m] - cw[lo]) - (cs[m] - cs[lo])
    cost = np.empty(len(a))
    cost[o] = ahead + behind
    return a[np.argmin(np.round(cost, 10))]
