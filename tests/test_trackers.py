"""The four detection methods against plain event-by-event simulations."""
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from helpers import blobs, flood, partition, to_spark
from pyspark.sql import functions as F

from ptrack import Params
from ptrack.fixtures import pixel_events
from ptrack.functions import pixels as px
from ptrack.functions.assign import assign_points
from ptrack.operators import cluster, detect, filters, raster
from ptrack.operators.blockfold import _in_runs, block_fold
from ptrack.operators.kdtree import RadiusTracker
from ptrack.operators.pixelwise import PixelwiseTracker
from ptrack.operators.slicing import slice_events, time_bounds

DT = 100.0


def slices(e, overlap):
    t0, n = e.t.min(), max(1, int(np.ceil((e.t.max() - e.t.min()) / DT)))
    for k in range(n):
        lo = t0 + (k - overlap) * DT if k else t0
        s = e[(e.t >= lo) & (e.t <= t0 + (k + 1) * DT)]
        yield k, s, (s.t < t0 + k * DT).to_numpy()


def simulate_pixelwise(e, p):
    live, out, born = {}, {}, 0          # live: id -> list of pixels (repeated per event)
    for k, s, over in slices(e, p.overlap):
        xy = list(zip(s.x, s.y))
        lab = flood(set(xy))
        owner = {q: c for c, px in live.items() for q in px}
        new, start = {}, []
        for l in range(1, max(lab.values(), default=0) + 1):
            ev = [i for i, q in enumerate(xy) if lab[q] == l]
            size = len({xy[i] for i in ev}) if k == 0 else len(ev)
            if size < p.min_pixels:
                continue
            ids = sorted({owner[xy[i]] for i in ev if owner.get(xy[i]) is not None and owner[xy[i]] not in new})
            if not ids:
                start.append(ev)
            elif len(ids) == 1:
                new[ids[0]] = ev
            else:
                c = np.array([np.mean(live[i], axis=0) for i in ids])
                far = np.hypot(*(c[:, None] - c[None]).transpose(2, 0, 1)) + np.eye(len(ids)) * 1e9
                c[(far < 4).any(axis=1)] = -1000
                got = {}
                for i in ev:
                    d = ((c - np.array(xy[i])) ** 2).sum(axis=1)
                    got.setdefault(ids[int(np.argmin(d))], []).append(i)
                for c_id, g in got.items():
                    if len(g) >= 4:
                        new[c_id] = g
        for ev in start:
            if k == 0 or sum(not over[i] for i in ev) > 5:
                new[born] = ev
                born += 1
        live = {c: (sorted({xy[i] for i in ev}) if k == 0 else [xy[i] for i in ev]) for c, ev in new.items()}
        idx = s.event_idx.to_numpy()
        for c, ev in new.items():
            out.setdefault(c, []).extend((c, k, idx[i]) for i in ev if not over[i])
    return partition(r for v in out.values() for r in v)


def brute_dbscan(s, eps, m):
    xy = s[["x", "y"]].to_numpy(float)
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= eps
    core = near.sum(axis=1) >= m
    lab, n = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if core[i] and lab[i] < 0:
            todo = [i]
            lab[i] = n
            while todo:
                a = todo.pop()
                if core[a]:
                    for b in np.flatnonzero(near[a] & (lab < 0)):
                        lab[b] = n
                        todo.append(b)
            n += 1
    return lab


def simulate_kdtree(e, p):
    live, out, born = {}, [], 0
    for k, s, _ in slices(e, 0):
        taken, nxt = np.zeros(len(s), bool), {}
        xy, idx = s[["x", "y"]].to_numpy(float), s.event_idx.to_numpy()
        for c, m in live.items():
            near = np.hypot(*(xy - m).T) <= p.epsilon + 4
            if near.sum() > p.min_pts:
                nxt[c] = np.median(xy[near], axis=0)
                taken |= near
                out += [(c, k, i) for i in idx[near]]
        rest = np.flatnonzero(~taken)
        lab = brute_dbscan(s.iloc[rest], p.epsilon, p.min_pts)
        top = lab.max(initial=-1) + 1
        for l in (range(top) if not p.compat_offbyone else range(top - 1) if k == 0 else range(1, top)):
            m = rest[lab == l]
            nxt[born] = np.median(xy[m], axis=0)
            out += [(born, k, i) for i in idx[m]]
            born += 1
        live = nxt
    return partition(out)


def simulate_dbscan(e, p):
    live, out, born = [], [], 0          # live: (id, centre) in label order
    for k, s, _ in slices(e, 0):
        lab = brute_dbscan(s, p.epsilon, p.min_pts)
        xy, idx = s[["x", "y"]].to_numpy(float), s.event_idx.to_numpy()
        top = lab.max(initial=-1) + (0 if p.compat_offbyone else 1)
        c = [np.median(xy[lab == l], axis=0) for l in range(top)]
        pick = {}
        for l in range(top):
            d = [np.hypot(*(c[l] - m)) for _, m in live]
            if d and min(d) < p.threshold:
                j = int(np.argmin(d))
                if j not in pick or d[j] < pick[j][0]:
                    pick[j] = (d[j], l)
        ids = {l: live[j][0] for j, (_, l) in pick.items()}
        nxt = []
        for l in range(top):
            if l not in ids:
                if p.compat_offbyone and l == 0 and k > 0:
                    continue
                ids[l] = born
                born += 1
            nxt.append((ids[l], c[l]))
            out += [(ids[l], k, i) for i in idx[lab == l]]
        live = nxt
    return partition(out)


def run(spark, e, p):
    ev = to_spark(spark, e)
    r = detect.run_once(ev, p, time_bounds(ev)).clusters.select("cluster_id", "k", "event_idx").collect()
    return partition(tuple(x) for x in r)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block,warm", [(1, 0), (3, 1), (64, 2)])
def test_pixelwise(spark, seed, block, warm):
    e = blobs(seed, particles=25, box=45)
    p = Params(dt=DT, block_slices=block, warmup_slices=warm)
    assert run(spark, e, p) == simulate_pixelwise(e, p)


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("block,warm", [(2, 1), (64, 2)])
def test_kdtree(spark, compat, block, warm):
    e = blobs(4, particles=15)
    p = Params(dt=DT, method="kdtree", min_pts=5, compat_offbyone=compat, block_slices=block, warmup_slices=warm)
    assert run(spark, e, p) == simulate_kdtree(e, p)


@pytest.mark.parametrize("make", [PixelwiseTracker, RadiusTracker])
def test_few_checks(spark, sf, make):
    """Blocks of one slice without warm-up: every start state is a wrong guess."""
    p = Params(block_slices=1, warmup_slices=0)
    ev = filters.positive(pixel_events(spark, sf))
    b = time_bounds(ev)
    counts = raster.pixel_counts(slice_events(ev, p.dt, p.overlap, b) if make is PixelwiseTracker else slice_events(ev, p.dt, bounds=b)).cache()
    n, log = counts.select("k").distinct().count(), []
    got = sorted(map(tuple, block_fold(counts, lambda: make(p), p, log).collect()))
    assert len(log) <= np.ceil(np.log2(n)) + 2 and log[0] > n // 2 and log[-1] == 0
    whole = p.with_(block_slices=128)
    assert got == sorted(map(tuple, block_fold(counts, lambda: make(whole), whole).collect()))


def test_long_memory(spark):
    """Two tracks that share a region all the time: a wrong start is never forgotten."""
    rows = [(3 * k + i, x, 5, DT * k + 4 * i) for k in range(70) for i, x in enumerate(range(20, 44))]
    rows += [(10_000 + i, x, 5, 5.0 * i) for i, x in enumerate([20, 21, 22, 23, 24, 40, 41, 42, 43])]
    e = pd.DataFrame(sorted(rows, key=lambda r: r[3]), columns=["event_idx", "x", "y", "t"])
    e["event_idx"] = range(len(e))
    p, log = Params(dt=DT, overlap=0.0, block_slices=1, warmup_slices=0), []
    ev = to_spark(spark, e)
    counts = raster.pixel_counts(slice_events(ev, p.dt, p.overlap, time_bounds(ev))).cache()
    got = sorted(map(tuple, block_fold(counts, lambda: PixelwiseTracker(p), p, log).collect()))
    whole = p.with_(block_slices=128)
    assert got == sorted(map(tuple, block_fold(counts, lambda: PixelwiseTracker(whole), whole).collect()))
    assert len(log) <= 9


@pytest.mark.parametrize("size", [3, 5])
def test_reach_of_regions(size):
    """Dilation of all regions at once against one region at a time."""
    r = np.random.default_rng(size)
    code = np.unique(np.concatenate([px.code(r.integers(0, 60, 150), r.integers(0, 40, 150)), px.code(r.integers(1270, 1280, 30), r.integers(700, 730, 30))]))
    lab = px.label(code, px.HALF4)
    keep = np.ones(lab.max(), bool)
    got = set(zip(*(a.tolist() for a in PixelwiseTracker._reach(code, lab, keep, size))))
    want = set()
    for l in range(1, lab.max() + 1):
        own = code[lab == l]
        x, y = own // px.STRIDE, own % px.STRIDE
        for c in px.dilate(own, size).tolist():
            if x.min() - 1 <= c // px.STRIDE <= x.max() + 1 and y.min() - 1 <= c % px.STRIDE <= y.max() + 1:
                want.add((c, l))
    assert got == want


@pytest.mark.parametrize("compat", [False, True])
def test_dbscan(spark, compat):
    e = blobs(5, particles=15)
    p = Params(dt=DT, method="dbscan", min_pts=5, compat_offbyone=compat, block_slices=3)
    assert run(spark, e, p) == simulate_dbscan(e, p)


def cheapest(cost):
    """Columns of the rows in the cheapest assignment, by trying all (rows <= columns)."""
    return min(permutations(range(cost.shape[1]), cost.shape[0]), key=lambda q: sum(cost[i, k] for i, k in enumerate(q)))


def distances(a, b):
    return np.hypot(a[:, None, 0] - b[:, 0], a[:, None, 1] - b[:, 1])


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in ((0, 3), (3, 0), (1, 4), (4, 4), (6, 4), (5, 7)):
        a, b = r.random((n, 2)), r.random((m, 2))
        rows, cols = assign_points(a, b)
        c = distances(a, b) if n <= m else distances(b, a)
        assert len(rows) == len(set(cols.tolist())) == min(n, m) and (np.diff(rows) > 0).all()
        assert np.isclose(distances(a, b)[rows, cols].sum(), sum(c[i, k] for i, k in enumerate(cheapest(c))))


@pytest.mark.parametrize("kind", ["even", "crowd", "grid", "moved"])
@pytest.mark.parametrize("n,m", [(90, 90), (60, 90), (90, 60)])
def test_assignment_has_no_cheaper_cycle(n, m, kind):
    """An assignment is the cheapest if no cycle of exchanges makes it cheaper; places
    without a partner get one of cost 0."""
    r = np.random.default_rng(n + m)
    a, b = r.random((n, 2)) * 100, r.random((m, 2)) * 100
    if kind == "crowd":
        a *= 0.05                                   # all want the same few
    elif kind == "grid":
        a, b = np.round(a / 12), np.round(b / 12)   # equal distances and repeated points
    elif kind == "moved":
        k = min(n, m)
        a[:k] = b[:k] + r.normal(size=(k, 2))
    rows, cols = assign_points(a, b)
    c = distances(a, b)
    if n > m:
        c, rows, cols = c.T, cols, rows
    size = c.shape[1]
    c = np.vstack([c, np.zeros((size - len(c), size))])
    of = np.full(size, -1)
    of[rows] = cols
    of[of < 0] = np.setdiff1d(np.arange(size), cols)
    change = c[:, of] - c[np.arange(size), of][:, None]     # row i takes the place of row j
    for k in range(size):
        change = np.minimum(change, change[:, k:k + 1] + change[k:k + 1])
    assert change.diagonal().min() > -1e-9


def test_assignment_of_many_points():
    """Ten thousand points that moved a little: their own partners are far nearer than others."""
    grid = np.stack(np.meshgrid(np.arange(100.0), np.arange(100.0)), -1).reshape(-1, 2) * 10
    order = np.random.default_rng(4).permutation(len(grid))
    rows, cols = assign_points(grid, grid[order] + 1.5)
    assert (order[cols] == rows).all()


def place(x, y):
    return round(x * 1e6) * 10 ** 10 + round(y * 1e6)


def simulate_centres(props, threshold):
    """Slice by slice: cheapest pairs of the centres before and the centres now, far ones undone."""
    live, out, born = [], [], 0
    for k in range(props.k.max() + 1):
        now = props[props.k == k][["xm", "ym"]].to_numpy()
        ids = [-1] * len(now)
        if len(live) and len(now):
            c = distances(np.array([x for _, x in live]), now)
            pairs = list(enumerate(cheapest(c))) if len(live) <= len(now) else [(i, j) for j, i in enumerate(cheapest(c.T))]
            for i, j in pairs:
                if c[i, j] < threshold:
                    ids[j] = live[i][0]
        for j, i in enumerate(ids):
            if i < 0:
                ids[j], born = born, born + 1
        live = list(zip(ids, now))
        out += [(i, k, place(*xy)) for i, xy in live]
    return partition(out)


def test_pseudoframe(spark):
    e = blobs(8, particles=6, slices=10, per=14, noise=5)
    p = Params(dt=DT, method="pseudoframe", block_slices=3)
    ev = to_spark(spark, e)
    sl = slice_events(ev, p.dt, bounds=time_bounds(ev))
    _, props = cluster.frame_centroids(raster.pseudo_frame(sl), p.filter_size, p.area)
    props = props.toPandas()
    assert props.groupby("k").size().max() > 2
    got = detect.run_once(ev, p, time_bounds(ev)).centers.collect()
    assert partition((r.cluster_id, r.k, place(r.xm, r.ym)) for r in got) == simulate_centres(props, p.threshold)
    assert all(np.isclose(r.tm, e.t.min() + (r.k + 0.5) * DT) for r in got)


def test_pseudoframe_of_another_sensor(spark):
    """The same scene beyond the default sensor, on one with as many pixels."""
    e = blobs(8, particles=6, slices=6, per=14, noise=5)
    e["x"] += 10                                # away from the border, which mirrors
    p = Params(dt=DT, method="pseudoframe")
    moved = e.assign(x=e.x + 1280)
    here, far = [detect.run_once(ev, q, time_bounds(ev)) for ev, q in ((to_spark(spark, e), p), (to_spark(spark, moved), p.with_(sensor_x=2560, sensor_y=360)))]
    got = [partition((r.cluster_id, r.k, place(r.xm - off, r.ym)) for r in d.centers.collect()) for d, off in ((here, 0), (far, 1280))]
    assert got[0] == got[1] != []


def test_post_filter_and_second_run(spark):
    e = blobs(6, particles=15)
    ev = to_spark(spark, e)
    p = Params(dt=DT, method="dbscan", min_pts=5)
    one = detect.detect(ev, p).clusters.toPandas()
    n = one.groupby("cluster_id").size()
    assert (n >= p.min_events).all()
    two = detect.detect(ev, p.with_(multirun=True)).clusters.toPandas()
    assert set(one.event_idx) <= set(two.event_idx)


def test_runs_are_not_split_by_an_adaptive_join(spark):
    rows = spark.createDataFrame([(i % 5, i, 0, i) for i in range(50)], "run long, blk long, place int, k int")
    runs = spark.range(5).select(F.col("id").alias("run"))
    joined = rows.join(runs.hint("merge"), "run")
    assert "REPARTITION_BY_NUM" in _in_runs(joined)._jdf.queryExecution().executedPlan().toString()
    # the same with the join that follows when one side turns out to be small
    got = _in_runs(rows.repartition(4, "run").join(F.broadcast(runs), "run")).withColumn("task", F.spark_partition_id())
    assert all(r.n == 1 for r in got.groupBy("run").agg(F.count_distinct("task").alias("n")).collect())


def test_second_run_reads_stored_events(spark, monkeypatch):
    """What the first run left is worked out once, not by each step of the second run, and it
    is the events without a cluster."""
    p = Params(method="dbscan", dt=100.0)
    e = blobs(4)
    ev = to_spark(spark, e)
    b = time_bounds(ev)
    d = detect.with_stored_events(detect.run_once(ev, p, b))
    assert "Join" not in d.clusters._jdf.queryExecution().executedPlan().toString()
    seen, run = [], detect.run_once
    monkeypatch.setattr(detect, "run_once", lambda rest, *a, **k: seen.append(rest) or run(rest, *a, **k))
    first = detect.post_filter(d, p)
    detect.second_run(ev, first, p, b, repaired=False)
    assert "Join" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    held = {r.event_idx for r in first.clusters.collect()}
    assert 0 < len(held) < len(e)
    assert {r.event_idx for r in seen[0].collect()} == set(e.event_idx) - held
