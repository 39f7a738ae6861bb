import numpy as np
import pandas as pd
from helpers import blobs, flood, to_spark

from ptrack.functions import pixels as px
from ptrack.operators import cluster, raster, slicing
from ptrack.params import SENSOR_X, SENSOR_Y


def frame(spark, pts):
    return spark.createDataFrame([(0, int(x), int(y)) for x, y in pts], "k int, x int, y int")


def test_labels_like_flood_fill(spark):
    r = np.random.default_rng(0)
    pts = {(int(x), int(y)) for x, y in r.integers(0, 25, (250, 2))}
    for con in (4, 8):
        got = cluster.label_regions(frame(spark, pts), con).toPandas()
        want = flood(pts, con == 8)
        assert {(x, y): l for x, y, l in zip(got.x, got.y, got.label)} == want


def test_labels_on_dilated_pixels(spark):
    got = cluster.label_regions(frame(spark, [(0, 0), (3, 0), (9, 9)]), 4, 3).toPandas()
    assert got.groupby("label").size().tolist() == [10, 9]      # clipped at the corner, bridged by dilation


def test_disc_filter_and_otsu_at_the_border(spark):
    r = np.random.default_rng(1)
    pts = {(0, 0), (1, 2), (SENSOR_X - 1, SENSOR_Y - 1), (SENSOR_X - 2, 5)} | {
        (int(x), int(y)) for x, y in r.integers(0, 12, (40, 2))}
    img = np.zeros((SENSOR_X, SENSOR_Y))
    for x, y in pts:
        img[x, y] = 1
    pad = np.pad(img, 3, mode="symmetric")
    dense = sum(pad[3 + i:3 + i + SENSOR_X, 3 + j:3 + j + SENSOR_Y] for i, j in px.disc(3))
    got = raster.disc_filter(frame(spark, pts)).toPandas()
    want = np.zeros_like(img)
    want[got.x, got.y] = got.hits
    assert np.array_equal(want, dense)
    n, edges = np.histogram(dense / 29, bins=256)
    c = (edges[1:] + edges[:-1]) / 2
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * c) / w1, (np.cumsum((n * c)[::-1]) / w2[::-1])[::-1]
    t = c[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]
    assert np.isclose(raster.otsu(raster.disc_filter(frame(spark, pts))).first().threshold, t)


def test_weighted_medians():
    r = np.random.default_rng(2)
    v, n, g = r.integers(0, 9, 400), r.integers(1, 5, 400), np.concatenate([np.arange(50), r.integers(0, 50, 350)])
    got = px.weighted_medians(g, v, n, 50)
    assert got.tolist() == [np.median(np.repeat(v[g == k], n[g == k])) for k in range(50)]
    assert len(px.weighted_medians(g[:0], v[:0], n[:0], 0)) == 0


def test_slices_are_closed_and_overlap(spark):
    e = pd.DataFrame({"event_idx": range(6), "x": 1, "y": 1, "t": [10.0, 109.0, 110.0, 180.0, 210.0, 310.0]})
    ev = to_spark(spark, e)
    got = {(r.event_idx, r.k) for r in slicing.slice_events(ev, 100.0).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (2, 1), (3, 1), (4, 1), (4, 2), (5, 2)}
    over = {(r.event_idx, r.k, r.is_overlap) for r in slicing.slice_events(ev, 100.0, 0.4).collect()}
    assert over == {(i, k, False) for i, k in got} | {(1, 1, True), (3, 2, True)}
    b = slicing.time_bounds(ev)
    assert ev.select(slicing.shift_window(b["t0"], 1, 250.0, b).alias("s")).first().s == 60.0


def test_pixel_counts(spark):
    e = blobs(7)
    c = raster.pixel_counts(slicing.slice_events(to_spark(spark, e), 100.0, 0.4)).toPandas()
    assert (c.n >= c.n_in).all() and not c.duplicated(["k", "x", "y"]).any()
    assert (c[c.k == 0].n == c[c.k == 0].n_in).all()


def test_pixels_beyond_the_default_sensor(spark):
    """A cluster at x = 1500, y = 900 is found like any other; a negative place is an error."""
    import pytest
    from ptrack import Params
    from ptrack.operators import detect
    near = [(i, 40 + i % 3, 30 + i % 2, float(i * 10)) for i in range(30)]
    far = [(100 + i, 1500 + i % 3, 900 + i % 2, float(i * 10)) for i in range(30)]
    make = lambda rows: spark.createDataFrame(rows, "event_idx bigint, x int, y int, t double")
    for method in ("dbscan", "kdtree", "pixelwise"):
        p = Params(dt=100.0, method=method, min_pts=3)
        found = detect.run_once(make(near + far), p, detect.time_bounds(make(near + far))).clusters
        per = found.groupBy("cluster_id").agg({"x": "min", "event_idx": "count"}).toPandas()
        assert sorted(per["min(x)"]) == [40, 1500], method
        assert per["count(event_idx)"].nunique() == 1, method
    with pytest.raises(Exception, match="no pixel"):
        detect.run_once(make([(0, -1, 5, 0.0)] + near), Params(dt=100.0, method="dbscan"), detect.time_bounds(make(near))).clusters.collect()


def test_medoid_ties_do_not_turn_with_the_number():
    from ptrack.functions.robust import angle_diff, circular_medoid
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 400, 700):
        a, w = rng.uniform(-np.pi, np.pi, n), rng.uniform(0.1, 1, n)
        cost = np.abs(angle_diff(a[:, None], a[None, :])) @ w
        assert circular_medoid(a, w) == a[np.argmin(np.round(cost, 10))]
    assert circular_medoid(np.array([0.5, 0.5 + 1e-14, -1.0, 2.0]), np.ones(4)) == 0.5


def test_stencils_shuffle_lit_pixels_only(spark):
    # copies of pixels used to be exploded before the shuffle, and the filtered frame could be broadcast
    f = frame(spark, [(0, 0), (3, 4), (9, 9)])
    counts = raster.pixel_counts(f.selectExpr("k", "x", "y", "0D t", "0L event_idx"))
    for df in (raster.disc_filter(f), cluster.dbscan_core(counts, 4.0, 2), cluster.smooth_frame(f, 3)):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_smoothed_pixels_are_above_the_threshold(spark):
    r = np.random.default_rng(5)
    rows = [(k, int(x), int(y)) for k in (0, 1) for x, y in np.unique(r.integers(0, 15, (60, 2)), axis=0)] + [(2, None, 3)]
    f = spark.createDataFrame(rows, "k int, x int, y int")
    s = raster.disc_filter(f)
    want = s.join(raster.otsu(s), "k").where("v > threshold").select("k", "x", "y")
    got = cluster.smooth_frame(f, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.k for r in s.select("k").distinct().collect()} == {0, 1}


def test_disc_hits_in_parts(monkeypatch):
    r = np.random.default_rng(6)
    x, y = r.integers(-2, 42, (2, 300))
    whole = px.disc_hits(x, y, 3, (40, 30))
    monkeypatch.setattr(px, "DISC_CELLS", 100)
    assert all(np.array_equal(a, b) for a, b in zip(px.disc_hits(x, y, 3, (40, 30)), whole))
    assert [len(c) for c in px.disc_hits([], [], 3, (40, 30))] == [0, 0, 0]


def test_core_counts_like_pairs(spark):
    r = np.random.default_rng(7)
    e = pd.DataFrame({"k": r.integers(0, 2, 300), "x": r.integers(0, 20, 300), "y": r.integers(0, 20, 300)})
    counts = raster.pixel_counts(spark.createDataFrame(e.assign(t=0.0, event_idx=range(300))).selectExpr("cast(k as int) k", "x", "y", "t", "event_idx"))
    for row in cluster.dbscan_core(counts, 2.5, 9).collect():
        n = ((e.k == row.k) & ((e.x - row.x) ** 2 + (e.y - row.y) ** 2 <= 6.25)).sum()
        assert (row.neighbours, row.core) == (n, n >= 9)
