"""Camera recordings in the public EVT 2.0 and EVT 3.0 formats."""
from __future__ import annotations

import numpy as np

# Word types of EVT 2.0 (top 4 bits of 32) and EVT 3.0 (top 4 bits of 16).
EVT2_OFF, EVT2_ON, EVT2_TIME_HIGH = 0x0, 0x1, 0x8
EVT3_ADDR_Y, EVT3_ADDR_X, EVT3_BASE_X = 0x0, 0x2, 0x3
EVT3_VECT_12, EVT3_VECT_8, EVT3_TIME_LOW, EVT3_TIME_HIGH = 0x4, 0x5, 0x6, 0x8


def header(path: str) -> tuple[dict[str, str], int]:
    """Text header lines ('% key value') and the offset of the first word."""
    info, at = {}, 0
    with open(path, "rb") as f:
        while True:
            line = f.readline()
            if not line.startswith(b"% "):
                break
            at += len(line)
            text = line[2:].decode("latin1").strip()
            if text == "end":
                break
            key, _, val = text.partition(" ")
            info[key.lower()] = val
    return info, at


def version(info: dict[str, str]) -> int:
    """2 or 3; other encodings are an error. A header that names none is EVT 2.0."""
    text = (info.get("evt", "") or info.get("format", "").upper().replace("EVT", "")).strip().split(";")[0].strip()
    if text in ("", "2", "2.0"):
        return 2
    if text in ("3", "3.0"):
        return 3
    raise ValueError(f"unsupported event encoding: EVT {text}")


def _last(values, at, n, start):
    """For each of n positions the latest value set at or before it."""
    out = np.full(n, -1, np.int64)
    out[at] = np.arange(len(at))
    out = np.maximum.accumulate(out)
    return np.where(out >= 0, values[np.maximum(out, 0)] if len(values) else start, start)


def _wraps(high, prev, turn):
    """Add a turn whenever a cyclic counter falls back by more than half a turn."""
    full = np.concatenate([[prev % turn], high])
    return prev - prev % turn + high + np.cumsum(np.diff(full) < -turn // 2) * turn


def decode2(words: np.ndarray, state: dict):
    kind = words >> 28
    th = np.flatnonzero(kind == EVT2_TIME_HIGH)
    high = _wraps((words[th] & 0x0FFFFFFF).astype(np.int64), state.get("high", 0), 1 << 28)
    base = _last(high, th, len(words), state.get("high", 0))
    if len(high):
        state["high"] = int(high[-1])
    e = np.flatnonzero(kind <= EVT2_ON)
    w = words[e].astype(np.int64)
    return (w >> 11) & 0x7FF, w & 0x7FF, (base[e] << 6) | ((w >> 22) & 0x3F), (kind[e] == EVT2_ON).astype(np.int64)


def decode3(words: np.ndarray, state: dict):
    words = words.astype(np.int64)
    kind, val, n = words >> 12, words & 0xFFF, len(words)
    pick = lambda k: np.flatnonzero(kind == k)
    hi, lo, yy, bx = pick(EVT3_TIME_HIGH), pick(EVT3_TIME_LOW), pick(EVT3_ADDR_Y), pick(EVT3_BASE_X)
    high = _wraps(val[hi], state.get("high", 0), 1 << 12)
    t_high = _last(high, hi, n, state.get("high", 0))
    t_low = _last(val[lo], lo, n, state.get("low", 0))
    y = _last(val[yy] & 0x7FF, yy, n, state.get("y", 0))
    # vectors move the base on by 12 or 8 pixels
    width = np.where(kind == EVT3_VECT_12, 12, np.where(kind == EVT3_VECT_8, 8, 0))
    moved = np.cumsum(width)
    base_x = _last((val[bx] & 0x7FF) - moved[bx], bx, n, state.get("base", 0)) + moved - width
    base_p = _last(val[bx] >> 11, bx, n, state.get("pol", 0))
    single = pick(EVT3_ADDR_X)
    idx, xs, ps = [single], [val[single] & 0x7FF], [val[single] >> 11]
    vec = np.flatnonzero(width > 0)
    for bit in range(12):
        on = vec[(bit < width[vec]) & ((val[vec] >> bit) & 1 == 1)]
        idx.append(on)
        xs.append(base_x[on] + bit)
        ps.append(base_p[on])
    idx, xs, ps = np.concatenate(idx), np.concatenate(xs), np.concatenate(ps)
    if n:
        state.update(high=int(t_high[-1]), low=int(t_low[-1]), y=int(y[-1]), pol=int(base_p[-1]),
                     base=int(base_x[-1] + width[-1]))
    o = np.lexsort((xs, idx))
    idx = idx[o]
    return xs[o], y[idx], (t_high[idx] << 12) | t_low[idx], ps[o]


def batches(path: str, words_per_batch: int = 4_000_000):
    """(x, y, t, p) arrays of bounded size, in file order."""
    info, at = header(path)
    dtype, decode = ("<u2", decode3) if version(info) == 3 else ("<u4", decode2)
    state: dict = {}
    with open(path, "rb") as f:
        f.seek(at)
        while True:
            words = np.frombuffer(f.read(words_per_batch * np.dtype(dtype).itemsize), dtype)
            if len(words) == 0:
                return
            yield decode(words, state)
