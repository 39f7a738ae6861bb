"""NumPy helpers on the lit pixels of one slice (at most one row per sensor pixel)."""
from __future__ import annotations

import numpy as np

from ptrack.params import SENSOR_X, SENSOR_Y

# Raster codes hold coordinates of 16 bits, whatever the sensor.
STRIDE = 1 << 16


def disc(r: float) -> list[tuple[int, int]]:
    """Integer offsets within distance r, the origin included."""
    n = int(r)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= r * r]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component, for edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    return root


def code(x, y) -> np.ndarray:
    """Raster position of a pixel, x major."""
    return np.asarray(x, np.int64) * STRIDE + np.asarray(y, np.int64)


def neighbours(codes: np.ndarray, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in the sorted raster codes that differ by an offset."""
    x, y = codes // STRIDE, codes % STRIDE
    pa, pb = [], []
    for i, j in offsets:
        ok = (y + j >= 0) & (y + j < STRIDE) & (x + i >= 0) & (x + i < STRIDE)
        src = np.flatnonzero(ok)
        want = codes[src] + i * STRIDE + j
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        hit = codes[at] == want
        pa.append(src[hit])
        pb.append(at[hit])
    return np.concatenate(pa), np.concatenate(pb)


def events_in_reach(codes: np.ndarray, n: np.ndarray, r: float) -> np.ndarray:
    """Events within distance r of each pixel, its own included, for sorted raster codes;
    offset by offset, so that no list of all pairs is kept."""
    got = np.zeros(len(codes), np.int64)
    for offset in disc(r):
        a, b = neighbours(codes, [offset])
        got[a] += n[b]
    return got


# Cells of an image that are counted at once.
DISC_CELLS = 1 << 18


def disc_hits(x: np.ndarray, y: np.ndarray, radius: float, sensor: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, hits): lit pixels in the disc around each pixel of an image, mirrored at the
    borders (edge pixel repeated), where there are any. Counted some columns at a time."""
    def mirrored(a, b, size):
        low, high = a < radius, a >= size - radius
        return np.concatenate([a, -a[low] - 1, 2 * size - 1 - a[high]]), np.concatenate([b, b[low], b[high]])
    width, height = sensor
    x, y = mirrored(np.asarray(x, np.int64), np.asarray(y, np.int64), width)
    y, x = mirrored(y, x, height)
    o = np.argsort(x, kind="stable")
    x, y = x[o], y[o]
    i, j = np.array(disc(radius)).T
    step, n = max(1, DISC_CELLS // height), int(radius)
    out = []
    for x0 in range(0, width, step):
        x1 = min(x0 + step, width)
        a, b = np.searchsorted(x, [x0 - n, x1 + n])
        if a == b:
            continue
        tx, ty = (x[a:b, None] + i).ravel(), (y[a:b, None] + j).ravel()
        ok = (tx >= x0) & (tx < x1) & (ty >= 0) & (ty < height)
        cells = np.bincount((tx[ok] - x0) * height + ty[ok])
        at = np.flatnonzero(cells)
        out.append((x0 + at // height, at % height, cells[at]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3


# Forward half of the 4- and 8-neighbourhood.
HALF4 = [(0, 1), (1, 0)]
HALF8 = [(0, 1), (1, -1), (1, 0), (1, 1)]


def label(codes: np.ndarray, half) -> np.ndarray:
    """1-based component labels of sorted raster codes, in raster order."""
    if len(codes) == 0:
        return np.empty(0, np.int64)
    root = components(len(codes), *neighbours(codes, half))
    return np.unique(root, return_inverse=True)[1].astype(np.int64) + 1


def dilate(codes: np.ndarray, size: int) -> np.ndarray:
    """Lit raster codes after dilation with a size x size square, clipped to the sensor,
    or to the pixels there are if they reach further."""
    if size <= 1 or len(codes) == 0:
        return codes
    h = size // 2
    x, y = codes // STRIDE, codes % STRIDE
    i, j = (g.ravel() for g in np.mgrid[-h:h + 1, -h:h + 1])
    xx, yy = (x[:, None] + i).ravel(), (y[:, None] + j).ravel()
    ok = (xx >= 0) & (xx < max(SENSOR_X, x.max() + 1)) & (yy >= 0) & (yy < max(SENSOR_Y, y.max() + 1))
    return np.unique(code(xx[ok], yy[ok]))


def dbscan(codes, n, first, eps: float, min_pts: int) -> np.ndarray:
    """Density labels of pixels with n events each, -1 for noise.

    codes are sorted; ``first`` ranks pixels by their first event. Clusters are
    numbered by their first core event, and a border pixel joins the lowest
    numbered cluster in reach."""
    m = len(codes)
    if m == 0:
        return np.empty(0, np.int64)
    a, b = neighbours(codes, disc(eps))
    weight = np.bincount(a, weights=n[b], minlength=m)
    core = weight >= min_pts
    both = core[a] & core[b]
    root = components(m, a[both], b[both])
    out = np.full(m, -1, np.int64)
    if not core.any():
        return out
    start = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(start, root[core], first[core])
    heads = np.flatnonzero(core & (root == np.arange(m)))
    rank = np.empty(m, np.int64)
    rank[heads[np.argsort(start[heads])]] = np.arange(len(heads))
    out[core] = rank[root[core]]
    edge = ~core[a] & core[b]
    best = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(best, a[edge], out[b[edge]])
    border = best < np.iinfo(np.int64).max
    out[border] = best[border]
    return out


def weighted_medians(group: np.ndarray, v: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values of each group 0, 1, ... (none empty), repeated n times."""
    o = np.lexsort((v, group))
    v, upto = v[o], np.cumsum(n[o])
    ends = np.cumsum(np.bincount(group, minlength=groups))
    total = upto[ends - 1] if groups else np.zeros(0)
    half = (total + np.concatenate([[0], total[:-1]])[:groups]) / 2
    return (v[np.searchsorted(upto, half, side="left")] + v[np.minimum(np.searchsorted(upto, half, side="right"), ends - 1)]) / 2
