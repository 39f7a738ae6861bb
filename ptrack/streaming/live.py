"""Running Kalman filter over a stream of clustered events, one state per cluster."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ptrack.functions import filter3
from ptrack.params import Params

# Fixed value: the start state comes from at most this many slices.
START_SLICES = 10

_OUT = "cluster_id bigint, t double, px double, vx double, py double, vy double"
_STATE = "wait array<double>, state array<double>, cov array<double>, t double"


def _start(t, z, dt):
    """Mean and slope over the first whole slices, like the batch filter."""
    st = np.floor(min(float(START_SLICES), (t[-1] - t[0]) / dt))
    m = t < t[0] + st * dt
    if not m.any():
        return None
    s = (t[m] - t[0]) * 1e-6
    d = s - s.mean()
    slope = d @ z[m] / (d @ d) if d @ d > 0 else np.zeros(2)
    return np.vstack([z[m].mean(axis=0), slope, np.zeros(2)])


def live_kalman(events: DataFrame, p: Params, idle_ms: int = 60_000) -> DataFrame:
    """Filtered positions and velocities (px/s) for a stream (cluster_id, t, x, y) whose
    events come in time order per cluster. Events wait in the state until they span
    START_SLICES slices, or until nothing arrived for ``idle_ms``."""
    need = START_SLICES * p.dt

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait, st, cov, last = state.get if state.exists else ([], [], [], 0.0)
        rows = np.array(wait, float).reshape(-1, 3)
        idle = state.hasTimedOut
        if not idle:
            rows = np.vstack([rows, *(b[["t", "x", "y"]].to_numpy(float) for b in batches)])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
        t, z = rows[:, 0], rows[:, 1:]
        if st:
            t, z = np.concatenate([[last], t]), np.vstack([np.zeros((1, 2)), z])
            start, c0 = np.array(st).reshape(3, 2), np.array(cov).reshape(3, 3)
        elif len(t) and (idle or t[-1] - t[0] >= need):
            start, c0 = _start(t, z, p.dt), np.eye(3) * p.p0 * 10.0
        else:
            start = None
        if start is not None and len(t) > 1:
            s, c = filter3.run(t, z, start, c0, p.q, p.r)
            yield pd.DataFrame({"cluster_id": int(key[0]), "t": t[1:], "px": s[:, 0, 0], "vx": s[:, 1, 0],
                                "py": s[:, 0, 1], "vy": s[:, 1, 1]})
            state.update(([], [float(v) for v in s[-1].ravel()], [float(v) for v in c.ravel()], float(t[-1])))
        elif not idle:
            state.update(([float(v) for v in rows.ravel()], st, cov, last))
        if idle:
            state.remove()
        else:
            state.setTimeoutDuration(idle_ms)

    return events.select("cluster_id", "t", "x", "y").groupBy("cluster_id").applyInPandasWithState(
        run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
