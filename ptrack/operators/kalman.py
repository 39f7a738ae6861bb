"""Kalman tracks from clusters: start values, filter, resampling, smoothing."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.functions import filter3
from ptrack.functions.ordered import dense_seq, with_halo
from ptrack.params import Params
from ptrack.session import cut_lineage, grouped

_S = ["px", "vx", "ax", "py", "vy", "ay"]


def initial_states(clusters: DataFrame, dt: float) -> DataFrame:
    """(cluster_id, x0, vx0, y0, vy0): mean position and least-squares slope (px/s)
    over the first min(10, whole slices) slices. A cluster shorter than one slice
    has no start state and makes no track."""
    span = clusters.groupBy("cluster_id").agg(F.min("t").alias("ts"), F.max("t").alias("te"))
    st = F.floor(F.least(F.lit(10.0), (F.col("te") - F.col("ts")) / dt))
    head = clusters.join(span, "cluster_id").where(F.col("t") < F.col("ts") + st * dt)
    return _line(head, "t")


def initial_states_centres(centers: DataFrame, dt: float) -> DataFrame:
    """The same for centre series: first min(4, whole slices) slices, end included."""
    c = centers.select("cluster_id", F.col("tm").alias("t"), F.col("xm").alias("x"), F.col("ym").alias("y"))
    span = c.groupBy("cluster_id").agg(F.min("t").alias("ts"), F.max("t").alias("te"))
    st = F.floor(F.least(F.lit(4.0), (F.col("te") - F.col("ts")) / dt))
    return _line(c.join(span, "cluster_id").where(F.col("t") <= F.col("ts") + st * dt), "t")


def _sums(s: Column, x: Column, y: Column) -> dict[str, Column]:
    """What a line through (s, x) and (s, y) is made from."""
    return {"n": F.count(s), "ms": F.avg(s), "x0": F.avg(x), "y0": F.avg(y), "vx": F.regr_slope(x, s), "vy": F.regr_slope(y, s),
            "lo": F.min(s), "hi": F.max(s)}


def _slopes() -> list[Column]:
    # one time stamp only: the minimum-norm line through (s, mean) in absolute time
    at = F.col("ts") * 1e-6 + F.col("ms")
    flat = F.col("lo") == F.col("hi")
    norm = at / (at * at + 1)
    return [F.col("x0"), F.when(flat, F.col("x0") * norm).otherwise(F.col("vx")).alias("vx0"),
            F.col("y0"), F.when(flat, F.col("y0") * norm).otherwise(F.col("vy")).alias("vy0")]


def _line(df: DataFrame, t: str) -> DataFrame:
    # times relative to the cluster's start keep the sums well conditioned
    s = (F.col(t) - F.col("ts")) * 1e-6
    g = (df.withColumn("s", s).groupBy("cluster_id")
         .agg(F.min("ts").alias("ts"), *[v.alias(n) for n, v in _sums(F.col("s"), F.col("x"), F.col("y")).items()]))
    return g.select("cluster_id", *_slopes())


def _whole_clusters(clusters: DataFrame, dt: float, order: list[str]) -> DataFrame:
    """(cluster_id, seq, t, x, y, last, n, x0, vx0, y0, vy0) sorted by cluster and sample, for
    clusters that fit into a chunk: sample numbers and ``initial_states`` (over n samples; none
    without any) come from windows over a cluster, after one shuffle."""
    w = Window.partitionBy("cluster_id")
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = clusters.where(F.col("cluster_id").isNotNull()).select("cluster_id", "t", "x", "y", *(c for c in order if c != "t"))
    rows = (rows.repartition(parts, "cluster_id")
            .select("*", F.min("t").over(w).alias("ts"), F.max("t").over(w).alias("te"), F.count(F.lit(1)).over(w).alias("_top"),
                    (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint").alias("seq")))
    st = F.floor(F.least(F.lit(10.0), (F.col("te") - F.col("ts")) / dt))
    head = lambda v: F.when(F.col("t") < F.col("ts") + st * dt, v)
    sums = _sums(head((F.col("t") - F.col("ts")) * 1e-6), head(F.col("x")), head(F.col("y")))
    rows = rows.select("*", *[v.over(w).alias(n) for n, v in sums.items()])
    # rows without a time are counted, before all others, and no samples
    return (rows.where(F.col("t").isNotNull()).select("cluster_id", "seq", "t", "x", "y", (F.col("seq") == F.col("_top") - 1).alias("last"), "n", *_slopes())
            .sortWithinPartitions("cluster_id", "seq"))


def _numbered(clusters: DataFrame, dt: float, order: list[str]) -> DataFrame:
    """Sample numbers per cluster, counted slice by slice, and a mark on the last."""
    return dense_seq(clusters, ["cluster_id"], F.floor(F.col("t") / dt), order, total="_top")\
        .withColumn("final", F.col("seq") == F.col("_top") - 1)


def _longest(df: DataFrame) -> int:
    n = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return n or 0


def _in_whole(batches, rows: int = 1 << 18):
    """Rows of whole clusters, about so many at a time, from batches sorted by cluster."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        pdf = pd.concat(held, ignore_index=True)
        ids = pdf.cluster_id.to_numpy()
        at = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
        if at:
            yield pdf.iloc[:at]
        held = [pdf.iloc[at:]]
        size = len(pdf) - at
    if size:
        yield pd.concat(held, ignore_index=True)


def _heads(batches, p: Params, lead: bool):
    """(cluster_id, sample numbers, marks, cuts, t, z, start states) of the first chunks in each
    lot of rows; clusters without a start state are left out."""
    for pdf in _in_whole(batches):
        ids = pdf.cluster_id.to_numpy(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        hi = np.append(lo[1:], len(ids))
        seq = pdf.seq.to_numpy(float)
        v = pdf[["x0", "vx0", "y0", "vy0"]].to_numpy(float)[lo]
        has = pdf.n.fillna(0).to_numpy(float)[lo] > 0
        lo = lo + np.isnan(seq[lo])                   # the start state has a row of its own
        has &= hi > lo
        lo, hi, v = lo[has], hi[has], v[has]
        if not len(lo):
            continue
        t, z = pdf.t.to_numpy(float), pdf[["x", "y"]].to_numpy(float)
        last = pdf["last"].fillna(False).to_numpy(bool) if "last" in pdf else np.zeros(len(pdf), bool)
        ts, zs = [], []
        for a, b in zip(lo, hi):
            if lead:
                gap = t[a + 1] - t[a] if b - a > 1 else p.step
                ts.append([t[a] - gap])
                zs.append(z[a:a + 1])
            ts.append(t[a:b])
            zs.append(z[a:b])
        start = np.zeros((len(lo), 3, 2))
        start[:, 0], start[:, 1] = v[:, [0, 2]], v[:, [1, 3]]
        yield (ids[lo], [seq[a:b].astype(np.int64) for a, b in zip(lo, hi)], [last[a:b] for a, b in zip(lo, hi)],
               np.concatenate([[0], np.cumsum(hi - lo + lead)]), np.concatenate(ts), np.concatenate(zs), start)


def _filter(clusters: DataFrame, samples, init, p: Params, gain: float, emit, schema: str,
            longest: int, order=None, lead: bool = False) -> DataFrame:
    """Filter each cluster's samples (cluster_id, seq, t, x, y), chunk by chunk.

    Clusters are cut into chunks of chunk_rows samples. First chunks are filtered
    at once, many clusters in step; each later chunk is summed up in one element of fixed size, the
    elements carry the state from chunk to chunk, and then all chunks are
    filtered in parallel from their true start state. Chunks overlap in one
    sample, the predecessor, whose state is known. With ``lead`` the first sample
    is filtered too, after a step of the first interval's length. Where no cluster is longer
    than a chunk and ``order`` is given, one shuffle numbers, starts and filters them;
    otherwise ``samples()`` and ``init()`` give samples and start values."""
    q, r, var = p.q, p.r, p.p0 * gain
    names = [c.split()[0] for c in schema.split(", ")]
    cov0 = np.eye(3) * var

    def frame(keys, parts):
        if not parts:
            return pd.DataFrame({c: [] for c in names})
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip(names, [np.repeat(keys, [len(x[0]) for x in parts]), *cols])))

    def first(batches):
        for ids, seq, last, cuts, t, z, start in _heads(batches, p, lead):
            s = filter3.run_many(t, z, cuts, start, cov0, q, r)
            yield frame(ids, [emit(n, m, t[a + 1:b], s[a + 1:b]) for n, m, a, b in zip(seq, last, cuts, cuts[1:])])

    if order is not None and longest <= p.chunk_rows:
        return _whole_clusters(clusters, p.dt, order).mapInPandas(first, schema)

    cut = with_halo(samples(), "seq", p.chunk_rows, before=1).drop("_halo")
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Start values travel as one extra row per group, not by a join.
    head = (cut.where("_c = 0").drop("_c").unionByName(init().withColumn("n", F.lit(1)), allowMissingColumns=True)
            .repartition(parts, "cluster_id").sortWithinPartitions("cluster_id", F.col("seq").asc_nulls_first()))
    done = head.mapInPandas(first, schema)
    if longest <= p.chunk_rows:
        return done

    cut = cut.withColumn("v", F.lit(None).cast("array<double>"))

    def prepare(pdf):
        st = pdf[pdf.v.notna()]
        pdf = pdf[pdf.v.isna()].sort_values("seq")
        return pdf.astype({"seq": "int64"}), pdf.t.to_numpy(float), pdf[["x", "y"]].to_numpy(float), np.asarray(st.v.iloc[0]) if len(st) else None

    tail = cut.where("_c > 0")
    form = "cluster_id bigint, c bigint, v array<double>"

    def head_summary(batches):
        for ids, _, _, cuts, t, z, start in _heads(batches, p, lead):
            rows = []
            for i in np.flatnonzero(np.diff(cuts) >= p.chunk_rows):      # else nothing follows
                a, b = cuts[i], cuts[i + 1]
                s, cov = filter3.run(t[a:b], z[a:b], start[i], cov0, q, r)
                rows.append((int(ids[i]), 0, [*map(float, s[-1].ravel()), *map(float, cov.ravel())]))
            yield pd.DataFrame(rows, columns=["cluster_id", "c", "v"])

    def summary(key, pdf):
        _, t, z, _ = prepare(pdf)
        v = np.concatenate([m.ravel() for m in filter3.element(t, z, q, r)])
        return pd.DataFrame({"cluster_id": [int(key[0])], "c": [int(key[1])], "v": [v.tolist()]})

    elements = (head.mapInPandas(head_summary, form)
                .unionByName(grouped(tail, "cluster_id", "_c").applyInPandas(summary, form)))

    def carry(batches):
        # rows arrive by cluster and chunk, one small row per chunk, as a stream
        cur = state = cov = None
        for pdf in batches:
            rows = []
            for cid, c, v in zip(pdf.cluster_id, pdf.c, pdf.v):
                v = np.asarray(v)
                if c == 0:
                    cur, state, cov = cid, v[:6].reshape(3, 2), v[6:].reshape(3, 3)
                    continue
                if cid != cur:                       # a cluster without a start state
                    continue
                rows.append((cid, c, [*map(float, state.ravel()), *map(float, cov.ravel())]))
                el = (v[:9].reshape(3, 3), v[9:15].reshape(3, 2), v[15:24].reshape(3, 3),
                      v[24:30].reshape(3, 2), v[30:].reshape(3, 3))
                state, cov = filter3.advance(state, cov, el)
            yield pd.DataFrame(rows, columns=["cluster_id", "_c", "carry"])

    carried = (elements.repartition("cluster_id").sortWithinPartitions("cluster_id", "c")
               .mapInPandas(carry, "cluster_id bigint, _c bigint, carry array<double>"))

    def later(key, pdf):
        pdf, t, z, v = prepare(pdf)
        if v is None:
            return frame([], [])
        state = v[:6].reshape(3, 2)
        s, _ = filter3.run(t, z, state, v[6:].reshape(3, 3), q, r)
        last = pdf["last"].to_numpy(bool) if "last" in pdf else np.zeros(len(pdf), bool)
        return frame([int(key[0])], [emit(pdf.seq.to_numpy(), last, t, np.concatenate([state[None], s]))])

    starts = cut_lineage(carried).select("cluster_id", F.col("_c").cast("bigint"), F.col("carry").alias("v"))
    rest = (grouped(tail.unionByName(starts, allowMissingColumns=True), "cluster_id", "_c")
            .applyInPandas(later, schema))
    return done.unionByName(rest)


def _flat(s: np.ndarray) -> np.ndarray:
    return s.transpose(0, 2, 1).reshape(-1, 6)


def kalman_series(clusters: DataFrame, p: Params, order=("t", "event_idx")) -> DataFrame:
    """Filtered state after every event but the first:
    (cluster_id, seq, t, px, vx, ax, py, vy, ay), velocities in px/s."""
    def emit(seq, last, t, s):
        # the first state of a later chunk is its predecessor's: already reported
        n = len(seq) - 1
        s = _flat(s)[len(s) - n:]
        return (seq[1:], t[len(t) - n:], *s.T)

    return _filter(clusters, lambda: _numbered(clusters, p.dt, list(order)).select("cluster_id", "seq", "t", "x", "y"),
                   lambda: initial_states(clusters, p.dt), p, 10.0, emit,
                   "cluster_id bigint, seq bigint, t double, " + ", ".join(f"{n} double" for n in _S),
                   _longest(clusters), list(order))


def interp_grid(series: DataFrame, step: float, cols=tuple(_S), chunk: int = 8192) -> DataFrame:
    """Linear interpolation of a series (cluster_id, seq, t, …) at the multiples
    of ``step`` from its first to its last time. Each sample serves the grid
    points up to its successor, so no range join is needed."""
    w = Window.partitionBy("cluster_id", "_c").orderBy("seq")
    s = with_halo(series, "seq", chunk, after=1)
    for c in ("t", *cols):
        s = s.withColumn(f"n_{c}", F.lead(c).over(w))
    s = s.where(~F.col("_halo"))
    g0 = F.ceil(F.col("t") / step)
    # the last sample serves a grid point that falls on it
    g1 = F.when(F.col("n_t").isNull(), F.floor(F.col("t") / step)).otherwise(F.ceil(F.col("n_t") / step) - 1)
    s = s.where(g1 >= g0).withColumn("g", F.explode(F.sequence(g0, g1)))
    tq = F.col("g") * step
    f = F.coalesce((tq - F.col("t")) / (F.col("n_t") - F.col("t")), F.lit(0.0))
    return s.select("cluster_id", F.col("g").cast("bigint").alias("g"), tq.alias("t"),
                    *[(F.col(c) + f * (F.coalesce(f"n_{c}", c) - F.col(c))).alias(c) for c in cols])


def kalman_grid(clusters: DataFrame, p: Params, order=("t", "event_idx")) -> DataFrame:
    """The filter resampled at multiples of dt/resol: (cluster_id, g, t, px … ay).
    Equals interp_grid(kalman_series(…)), but only grid points leave the task."""
    step = p.step

    def emit(seq, last, t, s):
        s = _flat(s)
        if len(t) == 0:
            g = np.empty(0, np.int64)
        else:
            # a chunk ends before its last sample, which the next chunk starts with
            g = np.arange(np.ceil(t[0] / step), np.floor(t[-1] / step) + 1).astype(np.int64)
            if not last.any():
                g = g[g * step < t[-1]]
        tq = g * step
        i = np.clip(np.searchsorted(t, tq, side="right") - 1, 0, None)
        j = np.minimum(i + 1, len(t) - 1)
        gap = t[j] - t[i]
        f = np.divide(tq - t[i], gap, out=np.zeros(len(tq)), where=gap > 0)[:, None]
        v = s[i] + f * (s[j] - s[i])
        return (g, tq, *v.T)

    def samples():
        return _numbered(clusters, p.dt, list(order)).select("cluster_id", "seq", "t", "x", "y", F.col("final").alias("last"))

    return _filter(clusters, samples, lambda: initial_states(clusters, p.dt), p, 10.0, emit,
                   "cluster_id bigint, g bigint, t double, " + ", ".join(f"{n} double" for n in _S),
                   _longest(clusters), list(order))


def endpoints(clusters: DataFrame, p: Params) -> DataFrame:
    """State after the second and after the last sample of each cluster."""
    s = kalman_series(clusters, p)
    v = F.struct("seq", "t", *_S)
    g = s.groupBy("cluster_id").agg(F.min(v).alias("a"), F.max(v).alias("b"))
    return (g.select("cluster_id", F.explode(F.array("a", "b")).alias("v")).distinct()
            .select("cluster_id", "v.*"))


def kalman_centres(centers: DataFrame, p: Params) -> DataFrame:
    """Filter over centre series, resampled by dead reckoning: between two centres
    the state moves on in round(Δt/step) sub-steps from the earlier one. Series
    have one row per slice; only their grid of sub-steps is built here."""
    step, d = p.step, p.step * 1e-6
    c = centers.select("cluster_id", F.col("tm").alias("t"), F.col("xm").alias("x"), F.col("ym").alias("y"))

    def emit(seq, last, t, s):
        rows_seq, rows_sub, rows = [], [], []
        if seq[0] == 0:
            rows_seq.append(0)
            rows_sub.append(0)
            rows.append(s[0])
        f = filter3.transition(d)
        for i in range(1, len(t)):
            state = s[i - 1]
            for j in range(int(np.round((t[i] - t[i - 1]) * 1e-6 / d))):
                state = f @ state
                rows_seq.append(seq[i])
                rows_sub.append(j + 1)
                rows.append(state)
        m = _flat(np.array(rows).reshape(-1, 3, 2))
        return (np.array(rows_seq, np.int64), np.array(rows_sub, np.int32), *m.T)

    samples = lambda: dense_seq(c, ["cluster_id"], F.floor(F.col("t") / (p.dt * 4096)), ["t"])
    raw = _filter(c, samples, lambda: initial_states_centres(centers, p.dt), p, 50.0, emit,
                  "cluster_id bigint, seq bigint, sub int, " + ", ".join(f"{n} double" for n in _S),
                  _longest(c), lead=True)
    # g counts the points; the grid starts, unaligned, at the first centre and is cut at its planned length
    pts = dense_seq(raw, ["cluster_id"], F.floor(F.col("seq") / 4096), ["seq", "sub"], "g")
    t_first, t_last = F.min("t"), F.max("t")
    plan = ((t_last - F.ceil(t_first / step) * step) / step).cast("bigint") + 1
    span = c.groupBy("cluster_id").agg(t_first.alias("ts"), plan.alias("total"))
    return (pts.join(span, "cluster_id").where(F.col("g") < F.col("total"))
            .select("cluster_id", "g", (F.col("ts") + F.col("g") * step).alias("t"), *_S))


def smooth3x2(tracks: DataFrame, cols, seq: str = "seq", chunk: int = 8192) -> DataFrame:
    """Two passes of a three-point mean with repeated edge values."""
    w = Window.partitionBy("cluster_id", "_c").orderBy(seq)
    d = with_halo(tracks, seq, chunk, before=2, after=2)
    for _ in range(2):
        d = d.select(*[((F.coalesce(F.lag(c).over(w), c) + F.col(c) + F.coalesce(F.lead(c).over(w), c)) / 3).alias(c)
                       if c in cols else F.col(c) for c in d.columns])
    return d.where(~F.col("_halo")).drop("_halo", "_c")


def kalman_points(source: DataFrame, p: Params, centres: bool = False) -> DataFrame:
    """Track points before smoothing: (cluster_id, seq, t, x, y, u, v, ax, ay) with
    u, v in px/s; seq is the grid number."""
    grid = kalman_centres(source, p) if centres else kalman_grid(source, p)
    return grid.select("cluster_id", F.col("g").alias("seq"), "t", F.col("px").alias("x"), F.col("py").alias("y"),
                                 F.col("vx").alias("u"), F.col("vy").alias("v"), "ax", "ay")
