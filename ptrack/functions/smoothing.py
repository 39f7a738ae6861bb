"""Cubic smoothing spline from per-cell moments.

The samples of a track are summed up per time cell; any cubic spline with knots
at cell borders can be fitted from those sums. The fit has the least third-
derivative jumps at the knots among all with a residual sum of at most s, the
criterion of Dierckx (Curve and Surface Fitting with Splines, 1993).

Normal equations and jumps are bands of half-width 3 and 4, so a fit takes time and
memory in proportion to the cells, with one knot per cell for any length. Several
degrees of smoothing are factored side by side."""
from __future__ import annotations

import numpy as np

MOMENTS = 7                 # powers 0..6 of the cell time, for the normal equations
SIDE_BY_SIDE = 32           # systems factored at once: 1.3 kB per cell

# The four cubic B-splines on one cell, by powers of the cell time.
BASIS = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0
JUMP = np.array([1.0, -4.0, 6.0, -4.0, 1.0])

# How the ladder of residual sums is walked.
START_RMS = 100.0
BOX_MARGIN = 100
BETTER = 1.02
WORSE = 1.15
FINE = 2e2

_BAND = 5
_UPPER = np.triu(np.ones((4, 4))).reshape(16, 1)
_STIFFEST, _LOOSEST = 9.0, -9.0                  # exponents of ten


def smoothing_ladder() -> np.ndarray:
    """Residual sums tried in turn, from stiff to loose."""
    return np.concatenate([
        np.arange(9e7, 0.9e7 - 1, -1e7),
        np.arange(9e6, 1.5e6, -1e6),
        [1.5e6, 1e6, 9.5e5],
        np.arange(9e5, 1e4, -1e5),
        np.arange(1e4, 0, -1e3),
        np.arange(1e3, 0, -1e2),
        np.arange(1e2, 0, -1e1),
        np.arange(1e1, 0, -1e0),
        np.arange(1e0, 0, -1e-1),
        np.arange(1e-1, 0, -1e-2)])


def _times(band: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Product of a symmetric band (n x 5, upper part) with the columns of c."""
    out = band[:, :1] * c
    for d in range(1, min(_BAND, len(c))):
        w = band[:-d, d:d + 1]
        out[:-d] += w * c[d:]
        out[d:] += w * c[:-d]
    return out


def _factor(band: np.ndarray) -> np.ndarray:
    """L D L' of the bands (n x 5 x systems), unit factors beside the pivots."""
    n, _, many = band.shape
    f = np.zeros(((n + 4) * _BAND, many))
    f[:n * _BAND] = band.reshape(n * _BAND, many)
    for i in range(0, n * _BAND, _BAND):
        row = f[i + 1:i + 5].copy()
        f[i + 1:i + 5] /= f[i]
        # element (i + d, i + e) of the band lies 4 d + e places on: 16 in a row
        f[i + 5:i + 21] -= (f[i + 1:i + 5, None] * row[None]).reshape(16, many) * _UPPER
    f = f[:n * _BAND].reshape(n, _BAND, many)
    if not (f[:, 0] > 0).all():
        raise np.linalg.LinAlgError("the band is not positive definite")
    return f


def _solve(f: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    n, _, many = f.shape
    y = np.zeros((n + 4, many))
    y[:n] = rhs
    for i in range(n):
        y[i + 1:i + 5] -= f[i, 1:] * y[i]
    y[:n] /= f[:, 0]
    for i in range(n - 1, -1, -1):
        y[i] -= (f[i, 1:] * y[i + 1:i + 5]).sum(axis=0)
    return y[:n]


class CellSpline:
    """Fits of x and y over cells g0, g0+1, …; g are the filled cells."""

    def __init__(self, g, s, sx, sy, xx, yy):
        s, sx, sy = (np.asarray(a, float) for a in (s, sx, sy))
        g = np.asarray(g, np.int64)
        self.g0 = int(g[0])
        cell = g - self.g0
        m = int(cell[-1]) + 1
        n = s[:, 0].sum()
        self.mean = np.array([sx[:, 0].sum() / n, sy[:, 0].sum() / n])
        self.total = np.array([np.sum(xx) - n * self.mean[0] ** 2, np.sum(yy) - n * self.mean[1] ** 2])
        blocks = BASIS @ s[:, np.add.outer(np.arange(4), np.arange(4))] @ BASIS.T
        self.G, self.P = np.zeros((m + 3, _BAND)), np.zeros((m + 3, _BAND))
        self.b = np.zeros((m + 3, 2))
        for a in range(4):
            for e in range(a, 4):
                np.add.at(self.G, (cell + a, e - a), blocks[:, a, e])
            for axis, part in enumerate((sx, sy)):
                np.add.at(self.b, (cell + a, axis), (part - self.mean[axis] * s[:, :4]) @ BASIS[a])
        for a in range(_BAND):
            for e in range(a, _BAND):
                self.P[a:a + m - 1, e - a] += JUMP[a] * JUMP[e]
        self.scale = self.G[:, 0].sum() / max(self.P[:, 0].sum(), 1.0)
        self.grid = None

    def _jumps(self, c):
        """P c by way of the jumps, which keeps small ones exact."""
        out = np.zeros_like(c)
        k = len(c) - 4
        if k > 0:
            j = sum(w * c[a:a + k] for a, w in enumerate(JUMP))
            for a, w in enumerate(JUMP):
                out[a:a + k] += w * j
        return out

    def _coefficients(self, level, axis):
        """Coefficients (n x systems) at 10^level times the stiffness, and residual sums."""
        coef, left = [], []
        for at in range(0, len(level), SIDE_BY_SIDE):
            mu, ax = self.scale * 10.0 ** level[at:at + SIDE_BY_SIDE], axis[at:at + SIDE_BY_SIDE]
            b = self.b[:, ax]
            f = _factor(self.G[:, :, None] + self.P[:, :, None] * mu)
            c = _solve(f, b)
            for _ in range(2):
                c = c + _solve(f, b - _times(self.G, c) - mu * self._jumps(c))
            coef.append(c)
            left.append(self.total[ax] + np.sum(c * (_times(self.G, c) - 2 * b), axis=0))
        return np.hstack(coef), np.concatenate(left)

    def fits(self, sums) -> np.ndarray:
        """B-spline coefficients (fits x n x 2) with residual sums ``sums`` per axis: the
        stiffest that stays below, or the end of the range of stiffness."""
        sums = np.asarray(sums, float)
        if self.grid is None:
            level = np.arange(_LOOSEST, _STIFFEST + 0.1)
            _, left = self._coefficients(np.tile(level, 2), np.repeat([0, 1], len(level)))
            self.grid = level, np.maximum.accumulate(left.reshape(2, -1), axis=1)
        level, left = self.grid
        axis, want = np.repeat([0, 1], len(sums)), np.log(np.tile(sums, 2))
        off = lambda r: np.log(np.maximum(r, 1e-300))
        i = np.array([np.searchsorted(left[a], s, side="right") for a, s in zip(axis, np.exp(want))])
        lo, hi = np.maximum(i - 1, 0), np.minimum(i, len(level) - 1)
        a, b = level[lo].astype(float), level[hi].astype(float)
        fa, fb = off(left[axis, lo]) - want, off(left[axis, hi]) - want
        mid = np.where(i == 0, a, b)
        open_ = lo != hi
        side = np.zeros(len(a), int)
        for step in range(60):
            if not open_.any():
                break
            q = np.flatnonzero(open_)
            with np.errstate(divide="ignore", invalid="ignore"):
                x = b[q] - fb[q] * (b[q] - a[q]) / (fb[q] - fa[q])
            bad = ~((x > a[q]) & (x < b[q])) | (step % 4 == 3)
            x = np.where(bad, (a[q] + b[q]) / 2, x)
            fx = off(self._coefficients(x, axis[q])[1]) - want[q]
            up = fx > 0
            # a bound that stays twice counts half (Illinois rule)
            fa[q] = np.where(up & (side[q] == 1), fa[q] / 2, fa[q])
            fb[q] = np.where(~up & (side[q] == -1), fb[q] / 2, fb[q])
            b[q], fb[q] = np.where(up, x, b[q]), np.where(up, fx, fb[q])
            a[q], fa[q] = np.where(up, a[q], x), np.where(up, fa[q], fx)
            side[q] = np.where(up, 1, -1)
            mid[q] = x
            open_[q] = (np.abs(fx) > 1e-10) & (b[q] - a[q] > 1e-12)
        coef, _ = self._coefficients(mid, axis)
        return coef.T.reshape(2, len(sums), -1).transpose(1, 2, 0)

    def fit(self, s: float) -> np.ndarray:
        """B-spline coefficients (n x 2) with residual sum s per axis."""
        return self.fits([s])[0]

    def at(self, coef, pos, order=0):
        """Value or slope (per cell) at positions in cells; past the end cells the
        last piece is continued."""
        u = np.asarray(pos, float) - self.g0
        c = np.clip(np.floor(u).astype(np.int64), 0, len(coef) - 4)
        tau = (u - c)[:, None]
        if order == 0:
            basis = np.hstack([np.ones_like(tau), tau, tau ** 2, tau ** 3]) @ BASIS.T
        else:
            basis = np.hstack([np.zeros_like(tau), np.ones_like(tau), 2 * tau, 3 * tau ** 2]) @ BASIS.T
        v = np.einsum("nr,nra->na", basis, coef[c[:, None] + np.arange(4)])
        return v + self.mean if order == 0 else v


def choose_fit(test: CellSpline, pos, mean_xy, box, target: float, ladder) -> float:
    """Walk down the ladder until the fit follows the moving means to ``target``.

    box: (xmin, xmax, ymin, ymax) of the samples widened by BOX_MARGIN."""
    if not np.isfinite(mean_xy).any():
        return ladder[0]
    rms, best, take = START_RMS, START_RMS, 0
    ahead: dict[int, np.ndarray] = {}
    for m, s in enumerate(ladder):
        if rms <= target:
            break
        if m not in ahead:
            ahead = dict(enumerate(test.fits(ladder[m:m + SIDE_BY_SIDE // 2]), m))
        v = test.at(ahead[m], pos)
        if not np.isfinite(v).all():
            continue
        rms = np.sqrt(np.nanmean(((mean_xy - v) ** 2).sum(axis=1)))
        (x0, y0), (x1, y1) = v.min(axis=0), v.max(axis=0)
        if x1 > box[1] or x0 < box[0] or y1 > box[3] or y0 < box[2]:
            if s < FINE:
                break
        elif rms < BETTER * best:
            take, best = m, rms
        elif rms >= WORSE * best and s < FINE:
            break
    return ladder[take]
