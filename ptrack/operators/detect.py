"""Detection: events -> clusters (cluster_id, k, event_idx, x, y, t) and their
centres (cluster_id, k, xm, ym, tm)."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.functions.assign import assign_points
from ptrack.functions.chains import node_id, slice_chains
from ptrack.operators import cluster, raster, repair
from ptrack.operators.blockfold import block_fold
from ptrack.operators.kdtree import RadiusTracker
from ptrack.operators.pixelwise import PixelwiseTracker
from ptrack.operators.slicing import slice_count, slice_events, time_bounds
from ptrack.operators.spatial import match_slices
from ptrack.params import Params
from ptrack.session import as_table, cut_lineage, grouped


SECOND_RUN = 1 << 61


@dataclass
class Detection:
    clusters: DataFrame
    centers: DataFrame
    steps: DataFrame         # (cluster_id, steps): slices in which a cluster was seen


def _centers(events: DataFrame) -> DataFrame:
    return (events.groupBy("cluster_id", "k")
            .agg(F.percentile("x", 0.5).alias("xm"), F.percentile("y", 0.5).alias("ym"),
                 F.percentile("t", 0.5).alias("tm")))


def _from_claims(sl: DataFrame, claims: DataFrame) -> Detection:
    claims = cut_lineage(claims)
    ev = sl.where(~F.col("is_overlap")) if "is_overlap" in sl.columns else sl
    ev = ev.join(claims.select("k", "x", "y", "cluster_id").hint("merge"), ["k", "x", "y"])
    ev = ev.select("cluster_id", "k", "event_idx", "x", "y", "t")
    steps = claims.groupBy("cluster_id").agg(F.count_distinct("k").alias("steps"))
    return Detection(ev, _centers(ev), steps)


def _sliced(ev: DataFrame, p: Params, b: Column, overlap: float = 0.0) -> DataFrame:
    """Slices of one recording, or of several with slice numbers of their own."""
    sl = slice_events(ev, p.dt, overlap, b)
    return sl.withColumn("k", (F.col("k") + F.col("rec.k0")).cast("int")) if "rec" in ev.columns else sl


def pixelwise(ev: DataFrame, p: Params, b: Column, wide: bool = False) -> Detection:
    sl = _sliced(ev, p, b, p.overlap)
    return _from_claims(sl, block_fold(raster.pixel_counts(sl), lambda: PixelwiseTracker(p, wide), p))


def kdtree(ev: DataFrame, p: Params, b: Column) -> Detection:
    sl = _sliced(ev, p, b)
    return _from_claims(sl, block_fold(raster.pixel_counts(sl), lambda: RadiusTracker(p), p))


def dbscan(ev: DataFrame, p: Params, b: Column) -> Detection:
    """Every cluster of slice k-1 is a live track with its own median as centre, so
    matching needs two neighbouring slices only: a join, no running state."""
    sl = _sliced(ev, p, b)
    labels = cut_lineage(cluster.dbscan(raster.pixel_counts(sl), p.epsilon, p.min_pts).where("label >= 0"))
    if p.compat_offbyone:
        return _compat_dbscan(sl, labels, p)
    meds = cut_lineage(cluster.cluster_medians(sl, labels))
    chains = slice_chains(match_slices(meds, p.threshold), p.block_slices)
    return _from_claims(sl, labels.join(chains, ["k", "label"]).select("k", "x", "y", "n", "cluster_id"))


def _compat_dbscan(sl: DataFrame, labels: DataFrame, p: Params) -> Detection:
    """The last label of a slice is ignored, and label 0 may extend a track but
    not start one."""
    top = labels.groupBy("k").agg(F.max("label").alias("top"))
    labels = cut_lineage(labels.join(top, "k").where("label < top").drop("top"))
    meds = cut_lineage(cluster.cluster_medians(sl, labels)).withColumn("is0", F.col("label") == 0)
    links = first_never_starts(meds, lambda live: match_slices(meds, p.threshold, live), p)
    chains = slice_chains(links, p.block_slices)
    return _from_claims(sl, labels.join(chains, ["k", "label"]).select("k", "x", "y", "n", "cluster_id"))


def first_never_starts(nodes: DataFrame, link, p: Params = Params()) -> DataFrame:
    """Links when the cluster flagged is0 of a slice k > 0 may extend a track but
    not start one. Whether it lives depends on the is0 cluster of slice k-1
    alone: the two possible outcomes per slice are linked separately, and a
    running switch over slices (one row each) picks the right one."""
    yes, no = cut_lineage(link(nodes)), cut_lineage(link(nodes.where(~F.col("is0"))))

    def matched(links, name):
        return links.select("k", "label", F.col("prev").isNotNull().alias(name))
    sw = (nodes.where("is0").select("k", "label").join(matched(yes, "a"), ["k", "label"])
          .join(matched(no, "b"), ["k", "label"]))
    w = Window.orderBy("k")
    gap = p.first(F.col("k")) | F.coalesce(F.lag("k").over(w) != F.col("k") - 1, F.lit(True))
    sw = sw.withColumn("gap", gap)
    sw = (sw.withColumn("reset", F.col("gap") | (F.col("a") == F.col("b")))
          .withColumn("value", F.when(p.first(F.col("k")), True).otherwise(F.col("b")))
          .withColumn("flip", (~F.col("reset") & F.col("b")).cast("int"))
          .withColumn("run", F.sum(F.col("reset").cast("int")).over(w)))
    r = Window.partitionBy("run").orderBy("k")
    sw = sw.withColumn("live", F.first("value").over(r) != (F.sum("flip").over(r) % 2 == 1))
    sw = cut_lineage(sw.select("k", "label", "live"))
    before = sw.select((F.col("k") + 1).alias("k"), F.col("live").alias("first_lives"))
    return (yes.join(no.select("k", "label", F.col("prev").alias("other")), ["k", "label"])
            .join(before, "k", "left")
            .withColumn("prev", F.when(F.coalesce("first_lives", F.lit(False)), F.col("prev")).otherwise(F.col("other")))
            .select("k", "label", "prev")
            .join(sw.where("not live").select("k", "label"), ["k", "label"], "left_anti"))


def assign_slices(props: DataFrame, threshold: float, live: DataFrame | None = None) -> DataFrame:
    """Links (k, label, prev) of minimum total distance between neighbouring
    slices; pairs at ``threshold`` or more are dropped afterwards. One group holds
    the centroids of two slices, fewer than the sensor has pixels, and near pairs of them
    only, never all."""
    both = (props.select("k", "label", "xm", "ym", F.lit(1).alias("cur"))
            .unionByName((props if live is None else live).select((F.col("k") + 1).alias("k"), "label", "xm", "ym", F.lit(0).alias("cur"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        a, c = pdf[pdf.cur == 0], pdf[pdf.cur == 1]
        prev = np.full(len(c), np.nan)
        dist = np.full(len(c), np.nan)
        if len(a) and len(c):
            old, new = a[["xm", "ym"]].to_numpy(), c[["xm", "ym"]].to_numpy()
            r, s = assign_points(old, new)
            far = np.hypot(*(old[r] - new[s]).T)
            ok = far < threshold
            prev[s[ok]] = a.label.to_numpy()[r[ok]]
            dist[s[ok]] = far[ok]
        return pd.DataFrame({"k": c.k.to_numpy(), "label": c.label.to_numpy(),
                             "prev": pd.array(prev, dtype="Float64").astype("Int64"), "dist": dist})

    return grouped(both, "k").applyInPandas(run, "k int, label bigint, prev bigint, dist double")


def pseudoframe(ev: DataFrame, p: Params, b: Column) -> Detection:
    """All centroids of slice k-1 are live, so the assignment needs two slices."""
    sensor = p.sensor_x, p.sensor_y
    sl = _sliced(ev, p, b)
    labels, props = cluster.frame_centroids(raster.pseudo_frame(sl, sensor), p.filter_size, p.area, sensor)
    labels, props = cut_lineage(labels), cut_lineage(props)
    links = assign_slices(props, p.threshold)
    if p.compat_offbyone:
        low = props.groupBy("k").agg(F.min("label").alias("low"))
        marked = props.join(low, "k").withColumn("is0", F.col("label") == F.col("low"))
        links = first_never_starts(marked, lambda live: assign_slices(props, p.threshold, live), p)
    chains = cut_lineage(slice_chains(links, p.block_slices))
    place, k = props, F.col("k")
    if "rec" in ev.columns:
        place, k = props.join(sl.select("k", "rec").distinct(), "k"), k - F.col("rec.k0")
    centers = (place.join(chains, ["k", "label"])
               .select("cluster_id", "k", "xm", "ym", (b["t0"] + p.dt / 2 + k * p.dt).alias("tm")))
    d = _from_claims(sl, labels.join(chains, ["k", "label"]).select("k", "x", "y", "cluster_id"))
    return Detection(d.clusters, cut_lineage(centers), d.steps)


def run_once(ev: DataFrame, p: Params, b: Column, wide: bool = False) -> Detection:
    if p.method == "pixelwise":
        return pixelwise(ev, p, b, wide)
    return {"kdtree": kdtree, "dbscan": dbscan, "pseudoframe": pseudoframe}[p.method](ev, p, b)


def repair_detection(d: Detection, p: Params, dt: float) -> Detection:
    """Link ends to starts and merge the linked clusters."""
    if p.method == "pseudoframe":
        cand = repair.candidates(repair.centre_end_points(d.centers), 1.5 * dt, p.repair_center_dist)
        order = ["te", "source"]
    else:
        cand = repair.candidates(repair.end_points(d.clusters, dt), dt, p.repair_dist)
        order = ["source"]
    roots = cut_lineage(repair.resolve(repair.one_to_one(cand, order), p.compat_repair))
    steps = repair.apply_links(d.steps, roots).groupBy("cluster_id").agg(F.sum("steps").alias("steps"))
    return Detection(repair.apply_links(d.clusters, roots), repair.apply_links(d.centers, roots), steps)


def _keep(d: Detection, ids: DataFrame) -> Detection:
    # counted from the events once, not for each of the three tables
    ids = cut_lineage(ids.select("cluster_id"))

    def only(df):
        return df.join(ids, "cluster_id", "left_semi")
    return Detection(only(d.clusters), only(d.centers), only(d.steps))


def event_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("events"))


def post_filter(d: Detection, p: Params) -> Detection:
    """Drop short-lived and small clusters of the first run."""
    if p.test_mode:
        return d
    n = event_counts(d.clusters)
    if p.method == "pseudoframe":
        s = d.centers.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("steps"))
        ids = n.join(s, "cluster_id").where((F.col("steps") >= p.min_steps) & (F.col("events") >= p.min_centers_events))
    else:
        ids = n.join(d.steps, "cluster_id").where((F.col("steps") >= p.min_steps) & (F.col("events") >= p.min_events))
    return _keep(d, ids)


def _cut(d: Detection) -> Detection:
    return Detection(as_table(d.clusters), as_table(d.centers), cut_lineage(d.steps))


def with_stored_events(d: Detection) -> Detection:
    """A detection by medians whose events are read more than once: they are joined to their
    clusters once."""
    ev = as_table(d.clusters)
    return Detection(ev, _centers(ev), d.steps)


def residual(ev: DataFrame, clusters: DataFrame) -> DataFrame:
    """Events no cluster of the first run holds. Numbers are those of a recording, times tell
    recordings apart."""
    return ev.join(clusters.select("event_idx", "t").hint("merge"), ["event_idx", "t"], "left_anti")


def second_run(ev: DataFrame, d: Detection, p: Params, b: Column, repaired: bool = True) -> Detection:
    """Run on the events left over, with slices longer by the factor, from the first
    run's time origin."""
    f = p.multi_factor
    p2 = p.with_(dt=p.dt * f, min_pts=p.min_pts * f if p.method == "dbscan" else p.min_pts)
    # slices, medians and claims of the second run all read what is left
    rest = as_table(residual(ev, d.clusters))
    if p.compat_second_run:
        rest = rest.where(F.col("t") <= b["t0"] + F.floor(slice_count(b, p.dt) / f) * p2.dt)
        b = F.struct(b["t0"].alias("t0"), (b["t0"] + F.floor(slice_count(b, p.dt) / f) * p2.dt).alias("t1")) if "rec" in ev.columns else ev.agg(F.struct(F.min("t").alias("t0"), (F.min("t") + F.floor(
            F.greatest(F.ceil((F.max("t") - F.min("t")) / p.dt), F.lit(1)) / f) * p2.dt).alias("t1")).alias("b")).scalar()
    found = _cut(run_once(rest, p2, b, wide=True))
    return repair_detection(found, p2, p2.dt) if repaired else found


def second_filter(d: Detection, p: Params) -> Detection:
    """Drop small clusters of the second run."""
    return _keep(d, event_counts(d.clusters).where(F.col("events") >= p.min_events))


def union_runs(second: Detection, first: Detection) -> Detection:
    """Clusters of both runs; ids of the second one get their own range."""
    def both(x, y):
        return x.withColumn("cluster_id", F.col("cluster_id") + F.lit(SECOND_RUN)).unionByName(y)
    return Detection(both(second.clusters, first.clusters), both(second.centers, first.centers), both(second.steps, first.steps))


def detect(ev: DataFrame, p: Params) -> Detection:
    """Full detection: first run, repair, filter, optional second run on the
    events left over with longer slices, union and a last repair."""
    b = F.col("rec") if "rec" in ev.columns else time_bounds(ev)
    if p.test_mode:
        first = ev.where(F.col("t") <= b["t0"] + p.dt)
        return _cut(run_once(first, p, b))
    d = _cut(run_once(ev, p, b))
    d = _cut(post_filter(repair_detection(d, p, p.dt), p))
    if p.multirun:
        d = _cut(union_runs(second_filter(second_run(ev, d, p, b), p), d))
    d = repair_detection(d, p, p.dt)
    if p.method == "pseudoframe":
        d = _keep(d, d.centers.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("c")).where("c > 2"))
    return _cut(d)
