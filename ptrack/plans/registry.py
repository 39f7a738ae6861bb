"""Every operator as a query over the driver tables: name -> f(spark, sf_dir)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ptrack.fixtures import pixel_events
from ptrack.operators import (cluster, detect, filters, kalman, raster, recordings, repair, report, slicing, spatial, spline,
                              track, validate)
from ptrack.params import Params
from ptrack.plans import pipeline
from ptrack.session import as_table, cut_lineage
from ptrack.sources import readers

P = Params()
BOX = (100, 700, 20, 90)
CROP = (4000.0, 20000.0)
# Particles of this stream start 38 px apart, so the neighbourhood is wider than the default.
NB = P.with_(nb_radius=80.0, nb_mad_factor=3.0, nb_angle_factor=3.0)

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rnd(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# --- shared inputs ------------------------------------------------------------

def events(spark, d):
    return pixel_events(spark, d)


def positive(spark, d):
    return filters.positive(events(spark, d))


def stream(spark, d):
    """Positive events as a table: slicing reads it for the bounds and for the data."""
    return as_table(positive(spark, d))


def closed(spark, d):
    return slicing.slice_events(stream(spark, d), P.dt)


def overlapping(spark, d):
    return slicing.slice_events(stream(spark, d), P.dt, P.overlap)


def truth(spark, d):
    """Clusters by the particle an event belongs to."""
    return positive(spark, d).withColumnRenamed("pid", "cluster_id").drop("p")


def clusters(spark, d):
    """The same as a table, as detection hands it over."""
    return as_table(truth(spark, d))


def centres(spark, d, sl=None):
    """(k, label, xm, ym, tm, events) per particle and slice."""
    return ((closed(spark, d) if sl is None else sl).groupBy("k", F.col("pid").alias("label"))
            .agg(F.percentile("x", 0.5).alias("xm"), F.percentile("y", 0.5).alias("ym"),
                 F.percentile("t", 0.5).alias("tm"), F.count(F.lit(1)).alias("events")))


def centre_series(spark, d):
    return centres(spark, d).select(F.col("label").alias("cluster_id"), "k", "xm", "ym", "tm")


def tracks(spark, d):
    return track.track(clusters(spark, d), P)


def checked(spark, d):
    return validate.validate(cut_lineage(tracks(spark, d)), P.with_(quality_filter=True))


def fragments(spark, d):
    """Truth clusters cut every five slices."""
    c = truth(spark, d)
    return c.withColumn("cluster_id", F.col("cluster_id") * 4096 + F.floor(F.col("t") / (5 * P.dt)))


def fragment_centres(spark, d):
    return (fragments(spark, d).groupBy("cluster_id", F.floor(F.col("t") / P.dt).cast("int").alias("k"))
            .agg(F.percentile("x", 0.5).alias("xm"), F.percentile("y", 0.5).alias("ym"),
                 F.percentile("t", 0.5).alias("tm")))


def counts(spark, d):
    return raster.pixel_counts(closed(spark, d))


def regions(spark, d, sl=None):
    return cluster.label_regions(raster.pseudo_frame(overlapping(spark, d) if sl is None else sl))


# --- sources ------------------------------------------------------------------

@query
def cast_float32(spark, d):
    # shifted past 2^24, where single precision drops microseconds
    return events(spark, d).select("event_idx", (F.col("t") + 16777216).cast("float").cast("double").alias("t"))


@query
def convert_time_limit(spark, d):
    return readers.limit_duration(events(spark, d), 10000.0).select("event_idx", "t")


@query
def preview_stats(spark, d):
    return readers.preview(events(spark, d).select("x", "y", "t", "p")).drop("type")


@query
def event_summary(spark, d):
    return readers.event_summary(events(spark, d))


# --- filters ------------------------------------------------------------------

@query
def filter_roi(spark, d):
    return filters.roi(events(spark, d), *BOX).select("event_idx", "x", "y")


@query
def filter_time(spark, d):
    return filters.time_crop(events(spark, d), *CROP).select("event_idx", "t")


@query
def filter_polarity(spark, d):
    return positive(spark, d).select("event_idx", "p")


@query
def filter_combined(spark, d):
    return filters.filter_counts(events(spark, d), BOX, CROP)


@query
def tracks_in_window(spark, d):
    w = report.tracks_in_window(cut_lineage(tracks(spark, d)), F.lit(6000.0), F.lit(12000.0))
    return rnd(w, {"x": 6, "y": 6, "u": 9, "v": 9})


@query
def mask_invalid_points(spark, d):
    m = filters.mask_invalid(checked(spark, d)).select("cluster_id", "seq", "t", "x", "y")
    return rnd(m, {"x": 6, "y": 6})


# --- slices -------------------------------------------------------------------

@query
def slice_closed(spark, d):
    return closed(spark, d).select("event_idx", "k")


@query
def slice_overlap(spark, d):
    return overlapping(spark, d).select("event_idx", "k", "is_overlap")


@query
def num_slices(spark, d):
    ev = positive(spark, d)
    b = ev.agg(F.struct(F.min("t").alias("t0"), F.max("t").alias("t1")).alias("b"))
    return b.select(slicing.slice_count(F.col("b"), P.dt).alias("n"))


@query
def display_window(spark, d):
    ev = stream(spark, d)
    b = slicing.time_bounds(ev)
    return slicing.display_window(ev, slicing.shift_window(b["t0"], 1, P.dt, b), P.dt).select("event_idx", "t")


@query
def nb_time_bins(spark, d):
    return slicing.half_open_bin(cut_lineage(tracks(spark, d)), P.nb_dt_factor * P.dt).select("cluster_id", "seq", "bin")


@query
def lightweight_median(spark, d):
    return centre_series(spark, d)


@query
def binned_mean(spark, d):
    med = spline.median_per_time(truth(spark, d))
    return rnd(spline.binned_mean(med, spline.fit_grid(med, P.step), P.dt), {"mx": 6, "my": 6})


@query
def multirun_residual(spark, d):
    r = detect.detect(stream(spark, d), P.with_(method="dbscan", multirun=True))
    return r.clusters.select("cluster_id", "k", "event_idx", "x", "y", "t")


# --- pixels, regions, density clusters ----------------------------------------

@query
def pseudo_frame(spark, d):
    return raster.pseudo_frame(closed(spark, d))


@query
def pixel_event_join(spark, d):
    sl = overlapping(spark, d)
    return sl.join(regions(spark, d, sl), ["k", "x", "y"]).select("k", "label", "event_idx")


@query
def dilate(spark, d):
    return raster.dilate(raster.pseudo_frame(closed(spark, d)), 3)


@query
def label_cc4(spark, d):
    return regions(spark, d)


@query
def region_size_filter(spark, d):
    sl = overlapping(spark, d)
    return cluster.region_sizes(regions(spark, d, sl), raster.pixel_counts(sl), P.min_pixels)


@query
def region_overlap(spark, d):
    return spatial.region_overlap(cut_lineage(regions(spark, d)))


@query
def region_overlap_dilated(spark, d):
    return spatial.region_overlap(cut_lineage(regions(spark, d)), 3)


@query
def dbscan_core(spark, d):
    return cluster.dbscan_core(counts(spark, d), P.epsilon, P.min_pts)


@query
def dbscan_labels(spark, d):
    return cluster.dbscan(counts(spark, d), P.epsilon, P.min_pts)


@query
def disc_filter(spark, d):
    return rnd(raster.disc_filter(raster.pseudo_frame(closed(spark, d)), P.filter_size), {"v": 9})


@query
def otsu_threshold(spark, d):
    return rnd(raster.otsu(raster.disc_filter(raster.pseudo_frame(closed(spark, d)), P.filter_size)), {"threshold": 9})


@query
def label_cc8(spark, d):
    return cluster.label_regions(cluster.smooth_frame(raster.pseudo_frame(closed(spark, d)), P.filter_size), 8)


@query
def regionprops(spark, d):
    return rnd(cluster.region_props(label_cc8(spark, d)), {"xm": 6, "ym": 6})


@query
def pf_centroids(spark, d):
    _, props = cluster.frame_centroids(raster.pseudo_frame(closed(spark, d)), P.filter_size, P.area)
    return rnd(props, {"xm": 6, "ym": 6})


# --- spatial joins and matches ------------------------------------------------

def _next_centres(spark, d):
    """Closed slices, and each particle's centre carried to the slice after."""
    ev = stream(spark, d)
    b = slicing.time_bounds(ev)
    sl = slicing.slice_events(ev, P.dt, bounds=b)
    c = centres(spark, d, sl).select((F.col("k") + 1).alias("k"), "label", "xm", "ym")
    return sl, c.where(F.col("k") < slicing.slice_count(b, P.dt))


@query
def radius_join(spark, d):
    sl, c = _next_centres(spark, d)
    return spatial.radius_counts(c, raster.pixel_counts(sl), P.epsilon + 4, "label", P.min_pts)


@query
def unclaimed_events(spark, d):
    sl, c = _next_centres(spark, d)
    c, r = cut_lineage(c), P.epsilon + 4
    claims = spatial.radius_counts(c, raster.pixel_counts(sl), r, "label", P.min_pts)
    return spatial.unclaimed(sl, c, claims, r, "label").select("event_idx", "k")


@query
def nn_match(spark, d):
    m = spatial.match_slices(cut_lineage(centres(spark, d)), P.threshold)
    return rnd(m.fillna(-1, ["prev", "dist"]), {"dist": 6})


@query
def hungarian_match(spark, d):
    m = detect.assign_slices(cut_lineage(centres(spark, d)), P.threshold)
    return rnd(m.fillna(-1, ["prev", "dist"]), {"dist": 6})


@query
def interp_grid(spark, d):
    from ptrack.functions.ordered import dense_seq
    c = centre_series(spark, d).select("cluster_id", F.col("tm").alias("t"), F.col("xm").alias("x"), F.col("ym").alias("y"))
    s = dense_seq(c, ["cluster_id"], F.floor(F.col("t") / (P.dt * 4096)), ["t"])
    return rnd(kalman.interp_grid(s, P.step, ("x", "y")), {"x": 6, "y": 6})


@query
def correction_join(spark, d):
    c = clusters(spark, d)
    med = spline.median_per_time(c)
    near = spline.near_points(c, spline.fit_grid(med, P.step), P.dt)
    return rnd(near.groupBy("cluster_id", "seq").agg(F.count(F.lit(1)).alias("events"), F.avg("x").alias("mx"),
                                                     F.avg("y").alias("my")), {"mx": 6, "my": 6})


@query
def repair_candidates(spark, d):
    ends = cut_lineage(repair.end_points(fragments(spark, d), P.dt))
    return repair.candidates(ends, P.dt, P.repair_dist).drop("te")


@query
def repair_pf_candidates(spark, d):
    ends = cut_lineage(repair.centre_end_points(fragment_centres(spark, d)))
    return repair.candidates(ends, 1.5 * P.dt, P.repair_center_dist).drop("te")


@query
def repair_tracks(spark, d):
    cand = repair_candidates(spark, d)
    return repair.resolve(repair.one_to_one(cand, ["source"]))


@query
def neighbor_join(spark, d):
    n = validate.neighborhood(tracks(spark, d), NB).select("cluster_id", "seq", "n_neighbors", "w_sum")
    return rnd(n, {"w_sum": 6})


@query
def track_cluster_map(spark, d):
    return report.track_cluster_map(tracks(spark, d))


# --- tracking of clusters -----------------------------------------------------

def _run(spark, d, method="dbscan", **kw):
    """(events, bounds, parameters, one run of a detection)"""
    ev, p = stream(spark, d), P.with_(method=method, **kw)
    b = slicing.time_bounds(ev)
    return ev, b, p, detect.run_once(ev, p, b)


def _raw_detection(spark, d, method):
    return _run(spark, d, method)[-1].clusters.select("cluster_id", "k", "event_idx", "x", "y", "t")


@query
def track_dbscan(spark, d):
    return _raw_detection(spark, d, "dbscan")


@query
def track_pixelwise(spark, d):
    return _raw_detection(spark, d, "pixelwise")


@query
def track_kdtree(spark, d):
    return _raw_detection(spark, d, "kdtree")


@query
def track_pseudoframe(spark, d):
    return _raw_detection(spark, d, "pseudoframe")


@query
def test_mode(spark, d):
    return detect.detect(stream(spark, d), P.with_(method="dbscan", test_mode=True)).clusters


@query
def cluster_post_filter(spark, d):
    _, _, p, r = _run(spark, d)
    kept = detect.post_filter(r, p)
    return kept.steps.join(detect.event_counts(kept.clusters), "cluster_id")


@query
def min_events_filter(spark, d):
    _, _, p, r = _run(spark, d)
    return detect.event_counts(detect.second_filter(r, p).clusters)


def _two_runs(spark, d):
    """First run, filtered, and the run on what it left, both without repair."""
    ev, b, p, r = _run(spark, d)
    first = detect.post_filter(detect.with_stored_events(r), p)
    return first, detect.second_run(ev, first, p, b, repaired=False), p


@query
def residual_run(spark, d):
    return _two_runs(spark, d)[1].clusters.select("cluster_id", "k", "event_idx", "x", "y", "t")


@query
def union_runs(spark, d):
    first, second, p = _two_runs(spark, d)
    return detect.union_runs(detect.second_filter(second, p), first).clusters.select("cluster_id", "k", "event_idx")


@query
def except_clustered(spark, d):
    ev = stream(spark, d)
    sl = slicing.slice_events(ev, P.dt)
    labels = cluster.dbscan(raster.pixel_counts(sl), P.epsilon, P.min_pts)
    return detect.residual(ev, sl.join(labels.where("label >= 0"), ["k", "x", "y"])).select("event_idx")


@query
def sort_events_by_time(spark, d):
    return report.time_order(events(spark, d), P.dt).select("event_idx", "t", "pos")


@query
def detect_pixelwise(spark, d):
    return detect.detect(stream(spark, d), P).clusters


# --- trajectories -------------------------------------------------------------

_STATE = {"px": 6, "vx": 3, "ax": 1, "py": 6, "vy": 3, "ay": 1}


@query
def kalman_init(spark, d):
    return rnd(kalman.initial_states(truth(spark, d), P.dt), {"x0": 6, "vx0": 4, "y0": 6, "vy0": 4})


@query
def kalman_init_pf(spark, d):
    return rnd(kalman.initial_states_centres(centre_series(spark, d), P.dt), {"x0": 6, "vx0": 4, "y0": 6, "vy0": 4})


@query
def kalman_filter(spark, d):
    return rnd(kalman.kalman_series(clusters(spark, d), P), _STATE)


@query
def kalman_resample(spark, d):
    return rnd(kalman.kalman_grid(clusters(spark, d), P), _STATE)


@query
def kalman_pf(spark, d):
    g = kalman.kalman_centres(cut_lineage(centre_series(spark, d)), P)
    return rnd(g, {"px": 5, "vx": 2, "ax": 0, "py": 5, "vy": 2, "ay": 0})


@query
def kalman_endpoints(spark, d):
    return rnd(kalman.endpoints(clusters(spark, d), P), _STATE)


@query
def smooth3x2(spark, d):
    pts = kalman.kalman_points(clusters(spark, d), P).drop("ax", "ay")
    return rnd(kalman.smooth3x2(pts, ["x", "y", "u", "v"]), {"x": 6, "y": 6, "u": 3, "v": 3})


@query
def median_per_t(spark, d):
    return spline.median_per_time(truth(spark, d))


@query
def bspline_fit(spark, d):
    return track.track(clusters(spark, d), P.with_(tracking="bspline"))


@query
def hybrid_xk_us(spark, d):
    return track.track(clusters(spark, d), P.with_(tracking="hybrid_xk_us"))


@query
def hybrid_xk_uks(spark, d):
    return track.track(clusters(spark, d), P.with_(tracking="hybrid_xk_uks"))


@query
def hybrid_xks_uks(spark, d):
    return track.track(clusters(spark, d), P.with_(tracking="hybrid_xks_uks"))


@query
def hybrid_positions(spark, d):
    """Times and places of hybrid tracks: those of the filter, smoothed."""
    return rnd(track.track(clusters(spark, d), P.with_(tracking="hybrid_xk_us")).select("cluster_id", "seq", "t", "x", "y"), {"x": 6, "y": 6})


@query
def cell_moments(spark, d):
    """What the spline fits see of a track: sums per time cell."""
    med = spline.median_per_time(truth(spark, d))
    m = spline.cell_moments(med, spline.fit_grid(med, P.step), P.step)
    return rnd(m.select("cluster_id", "g", F.col("s")[0].cast("bigint").alias("n"), F.col("s")[1].alias("s1"), F.col("s")[6].alias("s6"),
                        F.col("sx")[0].alias("sx0"), F.col("sx")[3].alias("sx3"), F.col("sy")[1].alias("sy1"), "xx", "yy"),
               {"s1": 6, "s6": 6, "sx0": 6, "sx3": 5, "sy1": 5, "xx": 4, "yy": 4})


@query
def offset_correction(spark, d):
    c = clusters(spark, d)
    pts = cut_lineage(kalman.kalman_points(c, P))
    out = track.correct_offset(pts, c, P.dt, P.beta).select("cluster_id", "seq", "t", "x", "y")
    return rnd(out, {"x": 6, "y": 6})


@query
def track_single_cluster(spark, d):
    """Test tracking of one cluster, the largest: the filter reaches the scan, but the
    choice reads the whole table."""
    c = clusters(spark, d)
    top = c.groupBy("cluster_id").count().agg(F.max_by("cluster_id", F.struct("count", -F.col("cluster_id")))).scalar()
    return rnd(track.track(c.where(F.col("cluster_id") == top), P), {"x": 6, "y": 6, "u": 9, "v": 9})


# --- validation ---------------------------------------------------------------

@query
def heading_variation(spark, d):
    return rnd(validate.track_shape(tracks(spark, d)).select("cluster_id", "angle"), {"angle": 6})


@query
def speed_variation(spark, d):
    return rnd(validate.track_shape(tracks(spark, d)).select("cluster_id", "velo"), {"velo": 6})


@query
def path_length(spark, d):
    return rnd(validate.track_shape(tracks(spark, d)).select("cluster_id", "path"), {"path": 6})


def _quality(spark, d, *cols):
    return rnd(validate.quality(tracks(spark, d), P).select("cluster_id", *cols), {c: 5 for c in cols})


@query
def robust_z(spark, d):
    return _quality(spark, d, "z_angle", "z_velo", "z_inv")


@query
def quantile_norm(spark, d):
    return _quality(spark, d, "q_angle", "q_velo", "q_inv")


@query
def quality_score(spark, d):
    return _quality(spark, d, "score")


@query
def quality_filter(spark, d):
    return checked(spark, d).where("ok").select("cluster_id", "seq", "t")


def _nb(spark, d, digits, *cols):
    n = validate.neighborhood(tracks(spark, d), NB).where(F.col("n_neighbors") >= NB.nb_min_neighbors)
    return rnd(n.select("cluster_id", "seq", *cols), {c: digits for c in cols})


@query
def weighted_median(spark, d):
    return _nb(spark, d, 9, "med_u", "med_v")


@query
def weighted_mad(spark, d):
    return _nb(spark, d, 9, "mad_u", "mad_v")


@query
def circular_medoid(spark, d):
    return _nb(spark, d, 6, "med_angle", "mad_angle")


@query
def neighborhood_filter(spark, d):
    n = validate.neighborhood(tracks(spark, d), NB)
    return rnd(n.select("cluster_id", "seq", "comp_dev", "dir_dev", "keep"), {"comp_dev": 4, "dir_dev": 4})


@query
def flag_track(spark, d):
    return validate.flag_tracks(checked(spark, d))


@query
def validation_stats(spark, d):
    return validate.validation_stats(checked(spark, d))


@query
def segment_validity(spark, d):
    return validate.segments(checked(spark, d))


@query
def export_tracks(spark, d):
    return rnd(validate.export_table(cut_lineage(checked(spark, d))), {"x": 6, "y": 6, "u": 9, "v": 9})


# --- reports ------------------------------------------------------------------

@query
def detection_stats(spark, d):
    ev, _, _, r = _run(spark, d)
    return rnd(report.detection_stats(r.clusters, ev, P.dt), {"mean_events": 6, "ratio": 6})


@query
def tracking_stats(spark, d):
    return rnd(report.tracking_stats(tracks(spark, d)), {"mean_ms": 6})


@query
def cluster_duration_hist(spark, d):
    return report.histogram(cut_lineage(report.durations(truth(spark, d))))


@query
def track_duration_hist(spark, d):
    return report.histogram(cut_lineage(report.durations(tracks(spark, d))))


@query
def cluster_means_window(spark, d):
    return rnd(report.means_in_window(truth(spark, d), F.lit(4000.0), F.lit(8000.0)), {"xm": 6, "ym": 6})


@query
def centers_window(spark, d):
    return report.centers_in_window(centre_series(spark, d), F.lit(4000.0), F.lit(8000.0))


@query
def cluster_rank(spark, d):
    return report.cluster_rank(truth(spark, d))


@query
def vmax_suggest(spark, d):
    t = cut_lineage(tracks(spark, d))
    return t.agg(F.round(F.max(F.lit(report.suggested_vmax(t))), 9).alias("vmax"))


@query
def speed_norm(spark, d):
    return rnd(report.speed_norm(cut_lineage(tracks(spark, d))), {"a": 6})


@query
def cluster_raster(spark, d):
    return report.cluster_raster(truth(spark, d), F.lit(4000.0), F.lit(8000.0))


# --- end to end ---------------------------------------------------------------

@query
def validated_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Pixelwise detection, Kalman tracks, quality filter, flat table."""
    return rnd(pipeline.run(as_table(events(spark, d)), P.with_(quality_filter=True)).table, {"x": 6, "y": 6, "u": 9, "v": 9})


@query
def recordings_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Two recordings of the same pixels at the same times, tracked at once: particles of
    even and of odd numbers, the latter moved onto their neighbours."""
    odd = F.col("pid") % 2
    ev = (events(spark, d).withColumn("stream_id", F.when(odd == 1, "b").otherwise("a"))
          .withColumn("x", (F.col("x") - 38 * odd).cast("int")))
    return rnd(recordings.run_recordings(as_table(ev), P.with_(quality_filter=True)).table, {"x": 6, "y": 6, "u": 9, "v": 9})
