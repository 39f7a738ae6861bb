"""Constant-acceleration Kalman filter over one bounded chunk of samples.

The covariance does not depend on the measurements and both axes share it, so
one covariance serves x and y."""
from __future__ import annotations

import numpy as np

FEW = 16      # chunks below which numbers are faster than arrays


def transition(d: float) -> np.ndarray:
    return np.array([[1.0, d, 0.5 * d * d], [0.0, 1.0, d], [0.0, 0.0, 1.0]])


def run(t, z, start, p0, q, r):
    """Filter samples t (µs), z (n x 2) after the sample at t[0], whose state is
    ``start`` (3 x 2) with covariance p0. Returns states (n-1 x 3 x 2) and the last
    covariance. q may be any symmetric 3 x 3 matrix."""
    n = len(t)
    out = np.empty((n - 1, 6))
    (q00, q01, q02), (_, q11, q12), (_, _, q22) = ((float(v) for v in row) for row in q)
    x0, x1, x2 = (float(v) for v in start[:, 0])
    y0, y1, y2 = (float(v) for v in start[:, 1])
    p00, p01, p02, p11, p12, p22 = (float(p0[i][j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    ts, zx, zy = np.asarray(t, float).tolist(), z[:, 0].tolist(), z[:, 1].tolist()
    for i in range(1, n):
        d = (ts[i] - ts[i - 1]) * 1e-6
        h = 0.5 * d * d
        x0, x1 = x0 + d * x1 + h * x2, x1 + d * x2
        y0, y1 = y0 + d * y1 + h * y2, y1 + d * y2
        # P <- A P A' + Q
        a00, a01, a02 = p00 + d * p01 + h * p02, p01 + d * p11 + h * p12, p02 + d * p12 + h * p22
        a11, a12 = p11 + d * p12, p12 + d * p22
        b00 = a00 + d * a01 + h * a02 + q00
        b01 = a01 + d * a02 + q01
        b02 = a02 + q02
        b11 = a11 + d * a12 + q11
        b12 = a12 + q12
        b22 = p22 + q22
        s = b00 + r
        k0, k1, k2 = b00 / s, b01 / s, b02 / s
        e = zx[i] - x0
        x0, x1, x2 = x0 + k0 * e, x1 + k1 * e, x2 + k2 * e
        e = zy[i] - y0
        y0, y1, y2 = y0 + k0 * e, y1 + k1 * e, y2 + k2 * e
        p00, p01, p02 = b00 - k0 * b00, b01 - k0 * b01, b02 - k0 * b02
        p11, p12, p22 = b11 - k1 * b01, b12 - k1 * b02, b22 - k2 * b02
        out[i - 1] = (x0, x1, x2, y0, y1, y2)
    cov = np.array([[p00, p01, p02], [p01, p11, p12], [p02, p12, p22]])
    return out.reshape(-1, 2, 3).transpose(0, 2, 1), cov


def run_many(t, z, cuts, start, p0, q, r):
    """``run`` for many chunks at once, with the same sums in the same order: chunk i has the
    samples cuts[i] to cuts[i + 1] of t (µs), z (n x 2) and the start state start[i] (3 x 2),
    all with covariance p0. Returns states (n x 3 x 2); the first of each chunk is its start.
    Chunks advance in step, the longest first; the last few go on one by one."""
    off, size = np.asarray(cuts[:-1]), np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    off, size = off[order], size[order]
    out = np.empty((len(t), 6))
    out[off[size > 0]] = start[order[size > 0]].transpose(0, 2, 1).reshape(-1, 6)
    (q00, q01, q02), (_, q11, q12), (_, _, q22) = ((float(v) for v in row) for row in q)
    (x0, x1, x2), (y0, y1, y2) = start[order, :, 0].T.astype(float), start[order, :, 1].T.astype(float)
    p00, p01, p02, p11, p12, p22 = (np.full(len(off), float(p0[i][j])) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))
    zx, zy = np.ascontiguousarray(z[:, 0], dtype=float), np.ascontiguousarray(z[:, 1], dtype=float)
    at = np.array(off)
    i = 1
    while True:
        n = int(np.searchsorted(-size, -i))          # chunks with more than i samples
        if n < FEW:
            break
        if n < len(at):
            at, x0, x1, x2, y0, y1, y2 = (v[:n] for v in (at, x0, x1, x2, y0, y1, y2))
            p00, p01, p02, p11, p12, p22 = (v[:n] for v in (p00, p01, p02, p11, p12, p22))
        d = (t[at + 1] - t[at]) * 1e-6
        at = at + 1
        h = 0.5 * d * d
        x0, x1 = x0 + d * x1 + h * x2, x1 + d * x2
        y0, y1 = y0 + d * y1 + h * y2, y1 + d * y2
        a00, a01, a02 = p00 + d * p01 + h * p02, p01 + d * p11 + h * p12, p02 + d * p12 + h * p22
        a11, a12 = p11 + d * p12, p12 + d * p22
        b00 = a00 + d * a01 + h * a02 + q00
        b01 = a01 + d * a02 + q01
        b02 = a02 + q02
        b11 = a11 + d * a12 + q11
        b12 = a12 + q12
        b22 = p22 + q22
        s = b00 + r
        k0, k1, k2 = b00 / s, b01 / s, b02 / s
        e = zx[at] - x0
        x0, x1, x2 = x0 + k0 * e, x1 + k1 * e, x2 + k2 * e
        e = zy[at] - y0
        y0, y1, y2 = y0 + k0 * e, y1 + k1 * e, y2 + k2 * e
        p00, p01, p02 = b00 - k0 * b00, b01 - k0 * b01, b02 - k0 * b02
        p11, p12, p22 = b11 - k1 * b01, b12 - k1 * b02, b22 - k2 * b02
        out[at] = np.stack([x0, x1, x2, y0, y1, y2], axis=1)
        i += 1
    for j in range(n):
        rest = slice(off[j] + i - 1, off[j] + size[j])
        state = np.array([[x0[j], y0[j]], [x1[j], y1[j]], [x2[j], y2[j]]])
        cov = np.array([[p00[j], p01[j], p02[j]], [p01[j], p11[j], p12[j]], [p02[j], p12[j], p22[j]]])
        out[off[j] + i:off[j] + size[j]] = run(t[rest], z[rest], state, cov, q, r)[0].transpose(0, 2, 1).reshape(-1, 6)
    return out.reshape(-1, 2, 3).transpose(0, 2, 1)


def element(t, z, q, r):
    """What a chunk does to any start state, as (A, b, C, eta, J): the filtered
    state is A (I + P J)^-1 (m + P eta) + b with covariance
    A (I + P J)^-1 P A' + C. Elements are folded sample by sample, in plain numbers
    as in ``run``: C and J are symmetric, A and b have a column per start value and axis."""
    (q00, q01, q02), (_, q11, q12), (_, _, q22) = ((float(v) for v in row) for row in q)
    cols = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]   # of A, then of b
    c00 = c01 = c02 = c11 = c12 = c22 = 0.0
    j00 = j01 = j02 = j11 = j12 = j22 = 0.0
    eta = [0.0] * 6
    ts, zs = np.asarray(t, float).tolist(), np.asarray(z, float).tolist()
    for i in range(1, len(ts)):
        d = (ts[i] - ts[i - 1]) * 1e-6
        h = 0.5 * d * d
        a00, a01, a02 = c00 + d * c01 + h * c02, c01 + d * c11 + h * c12, c02 + d * c12 + h * c22
        a11, a12 = c11 + d * c12, c12 + d * c22
        c00, c01, c02 = a00 + d * a01 + h * a02 + q00, a01 + d * a02 + q01, a02 + q02
        c11, c12, c22 = a11 + d * a12 + q11, a12 + q12, c22 + q22
        for v in cols:
            v[0] += d * v[1] + h * v[2]
            v[1] += d * v[2]
        s = c00 + r
        k0, k1, k2 = c00 / s, c01 / s, c02 / s
        g0, g1, g2 = cols[0][0], cols[1][0], cols[2][0]
        ex, ey = zs[i][0] - cols[3][0], zs[i][1] - cols[4][0]
        for n, g in ((0, g0), (2, g1), (4, g2)):
            eta[n] += g * ex / s
            eta[n + 1] += g * ey / s
        j00 += g0 * g0 / s
        j01 += g0 * g1 / s
        j02 += g0 * g2 / s
        j11 += g1 * g1 / s
        j12 += g1 * g2 / s
        j22 += g2 * g2 / s
        for v, e in zip(cols, (-g0, -g1, -g2, ex, ey)):
            v[0] += k0 * e
            v[1] += k1 * e
            v[2] += k2 * e
        c11, c12, c22 = c11 - k1 * c01, c12 - k1 * c02, c22 - k2 * c02
        c00, c01, c02 = c00 - k0 * c00, c01 - k0 * c01, c02 - k0 * c02
    m = np.array(cols).T
    return (m[:, :3], m[:, 3:], np.array([[c00, c01, c02], [c01, c11, c12], [c02, c12, c22]]), np.array(eta).reshape(3, 2),
            np.array([[j00, j01, j02], [j01, j11, j12], [j02, j12, j22]]))


def advance(state, p, el):
    """Start state and covariance carried through an element."""
    A, b, C, eta, J = el
    g = np.linalg.solve(np.eye(3) + p @ J, np.hstack([state + p @ eta, p]))
    cov = A @ g[:, 2:] @ A.T + C
    return A @ g[:, :2] + b, (cov + cov.T) / 2
