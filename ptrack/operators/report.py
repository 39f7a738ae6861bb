"""Report aggregates over clusters, centres and tracks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.functions.ordered import dense_seq, exact_quantiles
from ptrack.operators.slicing import slice_count, time_bounds
from ptrack.params import SENSOR_X, SENSOR_Y


def detection_stats(clusters: DataFrame, ev: DataFrame, dt: float, test_mode: bool = False) -> DataFrame:
    """Clusters found, mean events per cluster, share of events in a cluster."""
    b = time_bounds(ev)
    n = F.lit(1) if test_mode else slice_count(b, dt)
    total = ev.where(F.col("t") <= b["t0"] + n * dt).agg(F.count(F.lit(1))).scalar()
    pairs = clusters.select("cluster_id", "event_idx").distinct()
    per = pairs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    used = pairs.select("event_idx").distinct().agg(F.count(F.lit(1))).scalar()
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_events")) \
        .select("clusters", "mean_events", (used / total).alias("ratio"))


def tracking_stats(tracks: DataFrame) -> DataFrame:
    """Tracks that last, and their mean duration in ms."""
    d = tracks.groupBy("cluster_id").agg((F.max("t") - F.min("t")).alias("d")).where("d > 0")
    return d.agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.avg("d") / 1000, F.lit(0.0)).alias("mean_ms"))


def durations(df: DataFrame, t: str = "t") -> DataFrame:
    """Duration in ms of every cluster or track of two or more times."""
    return (df.groupBy("cluster_id").agg(F.count(t).alias("n"), ((F.max(t) - F.min(t)) / 1000).alias("ms"))
            .where("n >= 2").select("cluster_id", "ms"))


def histogram(d: DataFrame, col: str = "ms", bins: int = 100) -> DataFrame:
    """Counts in equal bins from minimum to maximum, the last one closed; a
    column without values has no bins."""
    b = d.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("b")).scalar()
    # a single value gets a range of width 1 around it
    flat = b["lo"] == b["hi"]
    lo = F.when(flat, b["lo"] - 0.5).otherwise(b["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(b["hi"] - b["lo"]) / bins
    i = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    filled = d.groupBy(i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = (d.agg(F.count(col).alias("c")).where("c > 0")
             .select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def means_in_window(clusters: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return (clusters.where((F.col("t") >= lo) & (F.col("t") <= hi)).groupBy("cluster_id")
            .agg(F.avg("x").alias("xm"), F.avg("y").alias("ym")))


def centers_in_window(centers: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Centres in a time window; a cluster whose times stay below 1e4 is in seconds."""
    top = centers.groupBy("cluster_id").agg(F.max("tm").alias("top"))
    us = F.when(F.col("top") < 1e4, F.col("tm") * 1e6).otherwise(F.col("tm"))
    return (centers.join(top, "cluster_id").withColumn("tm", us).drop("top")
            .where((F.col("tm") >= lo) & (F.col("tm") <= hi)))


def cluster_rank(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n, rank): clusters by size, largest first, then by id. Ranks come
    from counts per size, so no task sorts all clusters."""
    n = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    pos = dense_seq(n, ["n"], F.shiftright("cluster_id", 16), ["cluster_id"], "pos")
    return pos.join(off, "n").select("cluster_id", "n", (F.col("off") + F.col("pos") + 1).alias("rank"))


def suggested_vmax(tracks: DataFrame) -> float:
    """2.5 times the median speed over all points."""
    return 2.5 * (exact_quantiles(tracks.select(F.hypot("u", "v").alias("s")), {"m": ("s", 0.5)})["m"] or 0.0)


def speed_norm(tracks: DataFrame, vmax: float | None = None) -> DataFrame:
    """Speed as a fraction of vmax (default: the largest), clamped to [0, 1]."""
    s = F.hypot("u", "v")
    top = F.lit(vmax) if vmax else tracks.agg(F.max(F.hypot("u", "v"))).scalar()
    top = F.when(top <= 0, F.lit(1e-12)).otherwise(top)
    return tracks.select("cluster_id", "seq", F.least(F.greatest(s / top, F.lit(0.0)), F.lit(1.0)).alias("a"))


def cluster_raster(clusters: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(x, y, cluster_id): the last cluster drawn on each sensor pixel."""
    return (clusters.where((F.col("t") >= lo) & (F.col("t") <= hi)
                           & F.col("x").between(0, SENSOR_X - 1) & F.col("y").between(0, SENSOR_Y - 1))
            .groupBy("x", "y").agg(F.max("cluster_id").alias("cluster_id")))


def tracks_in_window(tracks: DataFrame, lo: Column, hi: Column, min_points: int = 2,
                     max_tracks: int | None = None) -> DataFrame:
    """Track points in [lo, hi] of tracks with min_points there; optionally of the
    first max_tracks tracks only."""
    d = tracks.where((F.col("t") >= lo) & (F.col("t") <= hi))
    ids = d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    if max_tracks is not None:
        ids = ids.orderBy("cluster_id").limit(max_tracks)
    return d.join(ids.select("cluster_id"), "cluster_id", "left_semi")


def track_cluster_map(tracks: DataFrame) -> DataFrame:
    """(cluster_id, track): position of each cluster's track."""
    from ptrack.functions.ordered import dense_ids
    return dense_ids(tracks, "cluster_id", "track", F.shiftright("cluster_id", 16))


def time_order(ev: DataFrame, dt: float) -> DataFrame:
    """Events with their position in time order, counted slice by slice."""
    return dense_seq(ev, [], F.floor(F.col("t") / dt), ["t", "event_idx"], "pos")
