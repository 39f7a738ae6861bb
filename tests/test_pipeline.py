import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect
from ptrack import Params
from ptrack.fixtures import pixel_events
from ptrack.functions.ordered import dense_seq
from ptrack.operators import kalman
from ptrack.streaming.live import live_kalman
from ptrack.streaming.slices import event_stream, slice_stream


def test_entry(spark):
    t = entry(spark).toPandas()
    assert list(t.columns) == ["t", "x", "y", "u", "v", "trackid"] and len(t) > 50


@pytest.mark.parametrize("name", ["preview_stats", "slice_overlap", "label_cc4", "dbscan_labels", "track_dbscan", "radius_join",
                                  "otsu_threshold", "kalman_resample", "kalman_pf", "offset_correction", "quality_score",
                                  "neighborhood_filter", "repair_tracks", "cluster_rank", "sort_events_by_time"])
def test_same_as_duckdb(spark, sf, name):
    assert compare(queries()[name](spark, sf).toPandas(), connect(sf).execute(oracle_sql()[name]).df()) == "ok"


def test_numbering_of_a_hot_key(spark):
    d = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("key"), (F.col("id") * 7919 % 5000).alias("v"))
    got = dense_seq(d, ["key"], F.floor(F.col("v") / 100), ["v"]).toPandas().sort_values(["key", "v"])
    assert got.groupby("key").seq.apply(lambda s: s.tolist() == list(range(len(s)))).all()


def test_slice_stream(spark, sf, tmp_path):
    ev = pixel_events(spark, sf).drop("pid")
    src, n = str(tmp_path / "in"), 4
    t1 = ev.agg(F.max("t")).first()[0]
    for i in range(n):      # files in time order
        (ev.where((F.col("t") >= t1 * i / n) & ((F.col("t") < t1 * (i + 1) / n) | F.lit(i == n - 1))).coalesce(1)
         .write.mode("append").parquet(src))
        time.sleep(0.1)
    p = Params(method="dbscan")
    q = (slice_stream(event_stream(spark, src), p, 1.0, 5000.0).writeStream.outputMode("append").format("memory")
         .queryName("slices").start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("slices").groupBy("k").agg(F.sum("n").alias("n")).toPandas().set_index("k").n
    pos = ev.where("p > 0").toPandas()
    assert len(got) > 3
    for k, c in got.items():        # every emitted slice is whole
        assert c == ((pos.t >= 1 + k * p.dt) & (pos.t <= 1 + (k + 1) * p.dt)).sum()


def test_live_kalman_equals_batch(spark, sf, tmp_path):
    c = pixel_events(spark, sf).where("p > 0").withColumnRenamed("pid", "cluster_id")
    src = str(tmp_path / "in")
    for a, b in ((0, 9000), (9000, 24000), (24000, 1e9)):
        c.where((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.1)
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (live_kalman(s, Params()).writeStream.outputMode("append").format("memory").queryName("live")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    # idle timers keep such a query busy, so wait for the rows instead of for the end
    n, stop_at = c.count(), time.time() + 60
    while sum(r["numInputRows"] for r in q.recentProgress) < n and time.time() < stop_at:
        time.sleep(0.5)
    q.stop()
    got = spark.table("live").groupBy("cluster_id").agg(F.max(F.struct("t", "px", "vx")).alias("m")).select("cluster_id", "m.*").toPandas()
    want = kalman.kalman_series(c, Params()).toPandas().sort_values("seq").groupby("cluster_id").last()
    for r in got.itertuples():
        assert r.t == want.t[r.cluster_id] and np.isclose(r.px, want.px[r.cluster_id], atol=0.2)
