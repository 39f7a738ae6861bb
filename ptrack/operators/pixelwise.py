"""Pixelwise extension: regions that touch a live track's pixels extend it."""
from __future__ import annotations

import numpy as np
import pandas as pd

from ptrack.functions import pixels as px
from ptrack.functions.chains import LABEL_BITS
from ptrack.operators.blockfold import Slice, Tracker
from ptrack.params import SENSOR_X, SENSOR_Y

# Smallest group of a split, and the distance below which two
# tracks in one region cannot be told apart.
SPLIT_MIN_EVENTS = 4
MERGE_DISTANCE = 4.0


class PixelwiseTracker(Tracker):
    """State: the pixels of each live track in the last slice, weighted by events."""

    def __init__(self, p, wide=False):
        super().__init__(p, wide)
        self.code = np.empty(0, np.int64)
        self.who = np.empty(0, np.int64)
        self.w = np.empty(0, np.int64)

    def step(self, s: Slice):
        size = self.p.structure
        lit = px.dilate(s.code, size)
        dil = px.label(lit, px.HALF4)
        lab = dil[np.searchsorted(lit, s.code)]
        if self.p.first(s.k):
            keep = np.bincount(dil, minlength=1)[1:] >= self.p.min_pixels
        else:
            keep = np.bincount(lab, weights=s.n, minlength=1)[1:] >= self.p.min_pixels
        lost, seen = self._pairs(s.code, lab, keep, size)
        many, claimed = np.bincount(lost, minlength=len(keep) + 1), np.bincount(seen, minlength=len(self.own))
        # a region and a track that meet nothing else belong together
        plain = (many[lost] == 1) & (claimed[seen] == 1)
        track = np.full(len(keep) + 1, -1)
        track[lost[plain]] = seen[plain]
        fresh = (many[1:] == 0) & keep
        at, who = [], []
        if not plain.all():
            order = np.argsort(lab, kind="stable")
            cuts = np.searchsorted(lab[order], np.arange(1, len(keep) + 2))
            free = np.ones(len(self.own), bool)
            for l in np.unique(lost[~plain]):
                mine = seen[lost == l]
                mine = mine[free[mine]]
                if len(mine) == 0:
                    fresh[l - 1] = True
                elif len(mine) == 1:
                    track[l] = mine[0]
                    free[mine] = False
                else:
                    self._split(s, order[cuts[l - 1]:cuts[l]], mine[np.argsort(self.key[mine])], free, at, who)
        if not self.p.first(s.k):
            fresh &= np.bincount(lab, weights=s.n_in, minlength=len(keep) + 1)[1:] > self.p.spawn_min_events
        born = np.flatnonzero(fresh) + 1
        track[born] = len(self.own) + np.arange(len(born))
        whole = np.flatnonzero(track[lab] >= 0)
        return self._advance(s, [*at, whole], [*who, track[lab[whole]]], (np.int64(s.k) << LABEL_BITS) | born)

    def _pairs(self, codes, lab, keep, size):
        """Regions and the live tracks they touch, by region and track."""
        if self.wide and size > 1 and len(codes):
            codes, lab = self._reach(codes, lab, keep, size)
        owner = self._owners(codes)
        hit = (owner >= 0) & keep[lab - 1] if len(codes) else np.zeros(0, bool)
        n = len(self.own) + 1
        both = np.unique(lab[hit] * n + owner[hit])
        return both // n, both % n

    def _owners(self, codes):
        if len(self.code) == 0 or len(codes) == 0:
            return np.full(len(codes), -1, np.int64)
        i = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[i] == codes, self.who[i], -1)

    @staticmethod
    def _reach(codes, lab, keep, size):
        """Pixels of each region after dilation, within one pixel around its box."""
        x, y = codes // px.STRIDE, codes % px.STRIDE
        top = len(keep) + 1
        lo, hi = np.full((2, top), px.STRIDE), np.full((2, top), -1)
        for j, v in enumerate((x, y)):
            np.minimum.at(lo[j], lab, v)
            np.maximum.at(hi[j], lab, v)
        h = size // 2
        i, j = (g.ravel() for g in np.mgrid[-h:h + 1, -h:h + 1])
        xx, yy, ll = (x[:, None] + i).ravel(), (y[:, None] + j).ravel(), np.repeat(lab, len(i))
        ok = (xx >= np.maximum(lo[0][ll] - 1, 0)) & (xx <= hi[0][ll] + 1) & (xx < np.maximum(SENSOR_X, hi[0][ll] + 1))
        ok &= (yy >= np.maximum(lo[1][ll] - 1, 0)) & (yy <= hi[1][ll] + 1) & (yy < np.maximum(SENSOR_Y, hi[1][ll] + 1))
        return px.code(xx[ok], yy[ok]), ll[ok]

    def _split(self, s, idx, tracks, free, at, who):
        """Give each pixel of a region shared by several tracks to the nearest one."""
        cx, cy = np.empty(len(tracks)), np.empty(len(tracks))
        for i, t in enumerate(tracks):
            m = self.who == t
            w = self.w[m]
            cx[i] = (self.code[m] // px.STRIDE * w).sum() / w.sum()
            cy[i] = (self.code[m] % px.STRIDE * w).sum() / w.sum()
        d = np.hypot(cx[:, None] - cx, cy[:, None] - cy)
        np.fill_diagonal(d, np.inf)
        lost = (d < MERGE_DISTANCE).any(axis=1)
        cx[lost] = cy[lost] = -1000.0
        x, y = s.code[idx] // px.STRIDE, s.code[idx] % px.STRIDE
        dist = (x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2
        near = dist.argmin(axis=1)
        tied = (dist == dist.min(axis=1)[:, None]) & self.entry[tracks]
        self.sensitive |= bool((tied.sum(axis=1) > 1).any())
        events = np.bincount(near, weights=s.n[idx], minlength=len(tracks))
        for i, t in enumerate(tracks):
            if events[i] >= SPLIT_MIN_EVENTS:
                mine = idx[near == i]
                at.append(mine)
                who.append(np.full(len(mine), t))
                free[t] = False

    def _advance(self, s, at, who, born):
        own = np.concatenate([self.own, born])
        entry = np.concatenate([self.entry, np.zeros(len(born), bool)])
        key = np.concatenate([self.key, born])
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        who = np.concatenate(who) if who else np.empty(0, np.int64)
        live, back = np.unique(who, return_inverse=True)
        self.own, self.entry, self.key = own[live], entry[live], key[live]
        o = np.argsort(s.code[at])
        self.code, self.who = s.code[at][o], back[o]
        self.w = np.ones(len(at), np.int64) if self.p.first(s.k) else s.n[at][o]
        return at, back

    def groups(self):
        low = np.full(len(self.own), np.iinfo(np.int64).max)
        np.minimum.at(low, self.who, self.code)
        g = np.empty(len(low), np.int64)
        g[np.argsort(low)] = np.arange(len(low))
        return g

    def state_rows(self):
        return pd.DataFrame({"x": self.code // px.STRIDE, "y": self.code % px.STRIDE, "n": self.w,
                             "g": self.groups()[self.who], "own": self.own[self.who],
                             "entry": self.entry[self.who]})

    def load(self, rows):
        c = px.code(rows.x, rows.y)
        o = np.argsort(c)
        g, first, back = np.unique(rows.g.to_numpy(np.int64), return_index=True, return_inverse=True)
        self.code, self.who, self.w = c[o], back[o], rows.n.to_numpy(np.int64)[o]
        self.own, self.entry = g, np.ones(len(g), bool)
        self.key = rows.key.to_numpy(np.int64)[first]
