import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ptrack import Params
from ptrack.functions import chains, ordered, robust
from ptrack.operators import recordings, repair, report, validate


def make_tracks(seed=0, n=30, m=8):
    r = np.random.default_rng(seed)
    rows = [(c, k, 2000.0 * k, *(r.uniform(0, 90, 2) if k == 0 else r.uniform(0, 90, 2)), *r.normal(0, 1e-3, 2))
            for c in range(n) for k in range(r.integers(1, m))]
    return pd.DataFrame(rows, columns=["cluster_id", "seq", "t", "x", "y", "u", "v"])


def test_quality_like_numpy(spark):
    t = make_tracks()
    got = validate.quality(spark.createDataFrame(t), Params()).toPandas().sort_values("cluster_id")
    a, v, l = [], [], []
    for _, g in t.groupby("cluster_id"):
        ang = np.unwrap(np.arctan2(g.v, g.u))
        a.append(np.abs(np.diff(ang)).mean() * 180 / np.pi if len(g) > 1 else 0.0)
        s = np.hypot(g.u, g.v)
        v.append(np.std(s) / (s.mean() + 1e-8))
        l.append(np.hypot(np.diff(g.x), np.diff(g.y)).sum() if len(g) > 1 else np.nan)
    l = np.array(l)
    inv = 1 / (l / (np.nanmedian(l) + 1e-8) + 1e-8)

    def term(x):
        x = np.asarray(x, float)
        z = (x - np.nanmedian(x)) / (np.nanmedian(np.abs(x - np.nanmedian(x))) + 1e-8)
        z = np.maximum(z, 0)
        return z / (np.nanpercentile(z, 95) + 1e-8)
    score = term(a) + term(v) + term(inv)
    assert np.allclose(got.score.astype(float), score, equal_nan=True)
    assert np.array_equal(got.ok, np.isfinite(score) & (score <= 2.0))


@pytest.mark.parametrize("limit", [20_000, 5])
def test_neighborhood_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(validate, "TILE_TARGETS", limit)
    t = make_tracks(1, 40)
    p = Params(nb_radius=25.0, nb_mad_factor=2.0, nb_angle_factor=2.0)
    got = validate.neighborhood(spark.createDataFrame(t), p).toPandas().sort_values(["cluster_id", "seq"], ignore_index=True)
    assert len(got) == len(t)
    b = np.floor(t.t / 4000)
    for i, r in t.sort_values(["cluster_id", "seq"]).reset_index(drop=True).iterrows():
        d = np.hypot(t.x - r.x, t.y - r.y)
        q = t[(b == np.floor(r.t / 4000)) & (d <= 25) & (t.cluster_id != r.cluster_id)]
        w = np.exp(-0.5 * d[q.index].to_numpy() ** 2 / 625)
        assert got.n_neighbors[i] == len(q)
        if len(q) < 3:
            assert got.keep[i]
            continue

        def med(x):
            o = np.argsort(x)
            return x[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)]
        u, v, ang = q.u.to_numpy(), q.v.to_numpy(), np.arctan2(q.v, q.u).to_numpy()
        dev = max(abs(r.u - med(u)) / (1.4826 * med(np.abs(u - med(u)))), abs(r.v - med(v)) / (1.4826 * med(np.abs(v - med(v)))))
        assert np.isclose(got.comp_dev[i], dev)
        wrap = lambda z: (z + np.pi) % (2 * np.pi) - np.pi
        c = ang[np.argmin([np.sum(w * np.abs(wrap(z - ang))) for z in ang])]
        turn = abs(wrap(np.arctan2(r.v, r.u) - c)) / (1.4826 * med(np.abs(wrap(ang - c))))
        assert np.isclose(got.dir_dev[i], turn)
        assert got.keep[i] == (not (dev > 2 or turn > 2))


def test_medoid_by_prefix_sums():
    r = np.random.default_rng(2)
    a, w = r.uniform(-np.pi, np.pi, 700), r.random(700)
    cost = np.abs(robust.angle_diff(a[:, None], a[None])) @ w
    assert robust.circular_medoid(a, w) == a[np.argmin(cost)]


def test_exact_quantiles_of_large_columns(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=5000), np.full(3000, 0.25), [np.nan] * 7])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    want = {q: np.nanpercentile(x, q * 100) for q in (0.0, 0.5, 0.95, 1.0)}
    for small in (10 ** 9, 10):
        monkeypatch.setattr(ordered, "SMALL", small)
        got = ordered.exact_quantiles(df, {str(q): ("x", q) for q in want})
        assert all(np.isclose(got[str(q)], v) for q, v in want.items())


def test_one_to_one_and_chains(spark):
    r = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, 12, (40, 2)) if a != b})
    links, ts, ss = {}, set(), set()
    for a, b in pairs:
        if a not in ts and b not in ss:
            links[b] = a
            ts.add(a)
            ss.add(b)
    got = repair.one_to_one(spark.createDataFrame(pairs, "target bigint, source bigint"), ["source"])
    assert {x.source: x.target for x in got.collect()} == links
    chain = spark.createDataFrame([(1, 5), (5, 3), (3, 9), (7, 8), (8, 7), (20, 21)], "target bigint, source bigint")
    roots = {x.cluster_id: x.root for x in repair.resolve(chain).collect()}
    assert roots == {5: 1, 3: 1, 9: 1, 8: 7, 21: 20}
    # one pass in target order: 1 takes 5, 3 takes 9, 5 (empty) takes 3 with 9, 7 takes 8, 8 takes all of 7
    compat = {x.cluster_id: x.root for x in repair.resolve(chain, compat=True).collect()}
    assert compat == {5: 1, 9: 5, 3: 5, 8: 8, 7: 8, 21: 20}


def test_reports(spark):
    t = make_tracks(5)
    s = spark.createDataFrame(t)
    n = report.cluster_rank(s).orderBy("rank").toPandas()
    want = t.groupby("cluster_id").size().reset_index(name="n").sort_values(["n", "cluster_id"], ascending=[False, True])
    assert n.cluster_id.tolist() == want.cluster_id.tolist() and n["rank"].tolist() == list(range(1, len(want) + 1))
    d = t.groupby("cluster_id").t.agg(lambda v: np.ptp(v) / 1000 if len(v) > 1 else np.nan).dropna()
    h = report.histogram(report.durations(s)).toPandas()
    c, _ = np.histogram(d, bins=100)
    assert dict(zip(h.bin, h.n)) == dict(enumerate(c))
    assert np.isclose(report.suggested_vmax(s), 2.5 * np.median(np.hypot(t.u, t.v)))
    ok = s.withColumn("ok", s.seq % 3 != 1)
    seg = {(r.cluster_id, r.seq): r.valid for r in validate.segments(ok).collect()}
    top = t.groupby("cluster_id").seq.max()
    assert seg == {(c, k): k % 3 != 1 and (k + 1) % 3 != 1 for c, m in top.items() for k in range(m)}


def _jobs(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_short_link_tables_take_few_jobs(spark):
    # every source has its first choice taken by the target before: one link a round, and a chain through all
    n = 40
    pairs = spark.createDataFrame([(i, s, float(s)) for i in range(n) for s in (i + 1, i + 2)], "target long, source long, te double")
    spark.sparkContext.setJobGroup("links", "")
    try:
        links = repair.one_to_one(pairs, ["te", "source"]).collect()
        roots = repair.resolve(repair.one_to_one(pairs, ["te", "source"])).collect()
        jobs = _jobs(spark, "links")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert sorted(links) == [(i, i + 1) for i in range(n)] and {r.root for r in roots} == {0} and len(roots) == n
    assert jobs <= 20


def test_one_task_gives_the_links_of_the_rounds(spark, monkeypatch):
    big = 1 << 61
    both = []
    for limit in (chains.ONE_TASK, 0):
        monkeypatch.setattr(chains, "ONE_TASK", limit)
        r = np.random.default_rng(4)
        got = []
        for size in (0, 60):
            pairs = {(int(t), int(s) + big): float(e) for t, s, e in zip(r.integers(0, 20, size), r.integers(0, 25, size), r.integers(0, 4, size))}
            cand = spark.createDataFrame([(*k, e) for k, e in pairs.items()], "target long, source long, te double")
            got += [sorted(map(tuple, repair.one_to_one(cand, order).collect())) for order in (["source"], ["te", "source"])]
            # paths and rings of several lengths, one of them a pair
            to = dict(enumerate(r.permutation(24).tolist())) if size else {}
            links = spark.createDataFrame([(b, a) for a, b in to.items() if a != b and a % 7], "target long, source long")
            got += [sorted(map(tuple, repair.resolve(links, compat).collect())) for compat in (False, True)]
            ring = spark.createDataFrame([(1, 2), (2, 1), (5, 4), (4, 3), (3, 5), (8, 7), (7, 6)][:size], "target long, source long")
            got += [sorted(map(tuple, repair.resolve(ring, compat).collect())) for compat in (False, True)]
            nodes = spark.createDataFrame([(1, 2, True), (2, 3, True), (3, 9, True), (4, 4, False), (5, 1, True)][:size], "node long, ref long, open boolean")
            got.append(sorted(map(tuple, chains.pointer_double(nodes).collect())))
        both.append(got)
    assert both[0] == both[1] and any(both[0])


def test_scores_are_stored_before_the_export(spark):
    # the table reads them twice, and held the plan of the scores each time
    pts = [(c, s, s * 2000.0, float(c + s), float(s * (c % 3)), 1e-3 * c, 1e-3) for c in range(6) for s in range(5)]
    tracks = spark.createDataFrame(pts, "cluster_id long, seq long, t double, x double, y double, u double, v double")
    tracks = tracks.withColumn("stream_id", F.when(F.col("cluster_id") % 2 == 1, "b").otherwise("a"))
    checked = validate.validate(tracks, Params(quality_filter=True), ["stream_id"])
    table = recordings.export_by_recording(checked)
    assert table.count() and table._jdf.queryExecution().analyzed().toString().count("LogicalRDD") <= 6
