import numpy as np
import pandas as pd
import pytest
from helpers import blobs, to_spark
from pyspark.sql import functions as F

from ptrack import Params
from ptrack.functions.ordered import quantiles_by
from ptrack.operators import detect, recordings
from ptrack.operators.validate import quality_terms

# id, seed, start and length: starts off the slices and off the point grid
FILMS = [("b", 3, 1037.0, 9), (None, 5, 0.0, 12)]


def films():
    for name, seed, start, slices in FILMS:
        e = blobs(seed, particles=6, slices=slices, noise=6)
        e["t"] += start
        yield name, e


@pytest.mark.parametrize("kw", [dict(method="pixelwise", multirun=True), dict(method="kdtree", compat_offbyone=True),
                                dict(method="dbscan", compat_offbyone=True), dict(method="pseudoframe", sensor_x=256, sensor_y=256)])
def test_side_by_side_equals_single_runs(spark, kw):
    p = Params(dt=100.0, min_events=8, min_centers_events=8, min_pts=4, epsilon=3.0, block_slices=4, **kw)
    every = None
    for name, e in films():
        d = to_spark(spark, e).withColumn("stream_id", F.lit(name).cast("string"))
        every = d if every is None else every.unionByName(d)
    every = every.cache()
    lay = recordings.lay_out(every, p)
    q = p.with_(slice_stride=lay.stride)
    found = detect.detect(recordings.side_by_side(every, lay), q)
    got = recordings.own_times(found.clusters, lay, "t").toPandas()
    centers = recordings.own_times(found.centers, lay, "tm").toPandas()
    some = 0
    for name, e in films():
        want = detect.detect(to_spark(spark, e), p)
        mine = lambda d: d[d.stream_id.isna() if name is None else d.stream_id == name]
        # numbers of clusters keep their order
        rank = lambda d: d.assign(cluster_id=d.cluster_id.rank(method="dense").astype(int))
        rows = lambda d: sorted(rank(d)[["cluster_id", "event_idx", "x", "y", "t"]].itertuples(index=False, name=None))
        assert rows(mine(got)) == rows(want.clusters.toPandas())
        where = lambda d: rank(d)[["cluster_id", "tm", "xm", "ym"]].sort_values(["cluster_id", "tm"]).to_numpy(float)
        assert np.allclose(where(mine(centers)), where(want.centers.toPandas()))
        some += len(mine(got))
    assert some


def test_no_events(spark):
    none = spark.createDataFrame([], "stream_id string, event_idx bigint, x int, y int, t double, p int")
    lay = recordings.lay_out(none, Params())
    assert lay.count == 0 and recordings.side_by_side(none, lay).count() == 0


def test_too_many_slices(spark):
    ev = spark.createDataFrame([("a", 0.0), ("a", 3e12), ("b", 0.0)], "stream_id string, t double")
    with pytest.raises(ValueError, match="slice numbers"):
        recordings.lay_out(ev, Params())


def test_quantiles_by_key(spark):
    r = np.random.default_rng(2)
    key = r.choice(["hot", "b", "c", ""], 30000, p=[0.7, 0.28, 0.019, 0.001])
    d = pd.DataFrame({"key": key, "x": np.round(r.normal(0, 3, len(key)), 2), "y": r.integers(0, 4, len(key)).astype(float)})
    d.loc[::97, "x"] = np.nan
    df = spark.createDataFrame(d).withColumn("key", F.nullif("key", F.lit(""))).cache()
    got = quantiles_by(df, ["key"], {"m": ("x", 0.5), "h": ("x", 0.95), "z": ("y", 0.1)}).toPandas()
    assert len(got) == 4
    for _, g in got.iterrows():
        rows = d[d.key == (g.key if isinstance(g.key, str) else "")]
        assert np.allclose([g.m, g.h, g.z], [rows.x.quantile(0.5), rows.x.quantile(0.95), rows.y.quantile(0.1)])


def test_plan_of_scores_by_recording_stays_small(spark):
    # each level of quantiles used to hold several copies of the plan below it
    shape = spark.createDataFrame([("a", i, float(i), float(i % 3), float(i + 1)) for i in range(9)],
                                  "stream_id string, cluster_id long, angle double, velo double, path double")
    t = quality_terms(shape, 0.95, ["stream_id"])
    assert t._jdf.queryExecution().analyzed().toString().count("LogicalRDD") < 9
