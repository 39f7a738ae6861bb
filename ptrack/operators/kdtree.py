"""Radius search: events near a track's last centre extend it."""
from __future__ import annotations

import numpy as np
import pandas as pd

from ptrack.functions import pixels as px
from ptrack.functions.chains import LABEL_BITS
from ptrack.operators.blockfold import Slice, Tracker

# Fixed value: added to the search range.
RANGE_MARGIN = 4.0


class RadiusTracker(Tracker):
    """State: the median centre of each live track. Tracks may share events."""

    def __init__(self, p, wide=False):
        super().__init__(p, wide)
        self.cx = np.empty(0)
        self.cy = np.empty(0)

    def step(self, s: Slice):
        r = self.p.epsilon + RANGE_MARGIN
        x, y = s.code // px.STRIDE, s.code % px.STRIDE
        # pixels in the strip of each track, then those within the radius
        lo, hi = np.searchsorted(x, np.ceil(self.cx - r)), np.searchsorted(x, np.floor(self.cx + r) + 1)
        many = hi - lo
        of = np.repeat(np.arange(len(self.own)), many)
        near = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        ok = (x[near] - self.cx[of]) ** 2 + (y[near] - self.cy[of]) ** 2 <= r * r
        of, near = of[ok], near[ok]
        alive = np.flatnonzero(np.bincount(of, weights=s.n[near], minlength=len(self.own)) > self.p.min_pts)
        place = np.full(len(self.own), -1)
        place[alive] = np.arange(len(alive))
        ok = place[of] >= 0
        who, at = place[of[ok]], near[ok]
        taken = np.zeros(len(x), bool)
        taken[at] = True
        rest = np.flatnonzero(~taken)
        lab = px.dbscan(s.code[rest], s.n[rest], s.rank[rest], self.p.epsilon, self.p.min_pts)
        top = lab.max(initial=-1) + 1
        spawn = np.arange(top)
        if self.p.compat_offbyone:
            spawn = spawn[:-1] if self.p.first(s.k) else spawn[1:]
        number = np.full(top + 1, -1)                                    # the last entry stands for noise
        number[spawn] = len(alive) + np.arange(len(spawn))
        new = number[lab] >= 0
        at, who = np.concatenate([at, rest[new]]), np.concatenate([who, number[lab[new]]])
        n = len(alive) + len(spawn)
        born = (np.int64(s.k) << LABEL_BITS) | spawn
        self.own = np.concatenate([self.own[alive], born])
        self.entry = np.concatenate([self.entry[alive], np.zeros(len(born), bool)])
        self.key = np.concatenate([self.key[alive], born])
        self.cx, self.cy = (px.weighted_medians(who, v[at], s.n[at], n) for v in (x, y))
        return at, who

    def groups(self):
        g = np.empty(len(self.own), np.int64)
        g[np.lexsort((self.cy, self.cx))] = np.arange(len(g))
        return g

    def state_rows(self):
        return pd.DataFrame({"xm": self.cx, "ym": self.cy, "g": self.groups(), "own": self.own,
                             "entry": self.entry})

    def load(self, rows):
        rows = rows.sort_values("g")
        self.cx, self.cy = rows.xm.to_numpy(float), rows.ym.to_numpy(float)
        self.own, self.key = rows.g.to_numpy(np.int64), rows.key.to_numpy(np.int64)
        self.entry = np.ones(len(rows), bool)
