"""Tracks from clusters by five methods, with optional offset correction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ptrack.functions.ordered import dense_seq
from ptrack.operators import kalman
from ptrack.operators.spline import fit_splines, near_points
from ptrack.params import Params
from ptrack.session import cut_lineage

_COLS = ["cluster_id", "seq", "t", "x", "y", "u", "v"]


def correct_offset(points: DataFrame, events: DataFrame, dt: float, beta: float) -> DataFrame:
    """Move each point back along its velocity by beta times the events' spread
    across the velocity, within dt/2 of the point. Points without events become
    null; points at rest stay. Velocity units do not matter."""
    pts = points.select("cluster_id", "seq", "t", "u", "v")
    speed = F.hypot("u", "v")
    across = (-F.col("x") * F.col("v") + F.col("y") * F.col("u")) / F.nullif(speed, F.lit(0.0))
    s = (near_points(events.select("cluster_id", "t", "x", "y"), pts, dt)
         .groupBy("cluster_id", "seq").agg(F.coalesce(F.stddev_pop(across), F.lit(0.0)).alias("sigma")))
    n = F.hypot("u", "v")
    back = lambda c, w: F.when(n == 0, F.col(c)).otherwise(F.col(c) - beta * F.col("sigma") * F.col(w) / n)
    d = points.join(s, ["cluster_id", "seq"], "left")
    return d.select(*[back("x", "u").alias(c) if c == "x" else back("y", "v").alias(c) if c == "y" else F.col(c)
                      for c in points.columns])


def _close_gaps(points: DataFrame) -> DataFrame:
    """Drop points without a position and number the rest anew."""
    ok = points.where(F.col("x").isNotNull() & ~F.isnan("x"))
    return dense_seq(ok.withColumnRenamed("seq", "_s"), ["cluster_id"], F.floor(F.col("_s") / 4096), ["_s"]).drop("_s")


def _longer_than(points: DataFrame, n: int) -> DataFrame:
    ids = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)
    return points.join(ids.select("cluster_id"), "cluster_id", "left_semi")


def track(clusters: DataFrame, p: Params, centers: DataFrame | None = None) -> DataFrame:
    """(cluster_id, seq, t, x, y, u, v) with velocities in px/µs. With the
    pseudo-frame method the centre series are tracked instead of the events."""
    use_centres = p.method == "pseudoframe"
    source = centers if use_centres else clusters
    events = clusters
    # centre series have four times the point distance as their correction window
    window = 4 * p.step if use_centres else p.dt
    fix = (lambda d: correct_offset(d, events, window, p.beta)) if p.correction else (lambda d: d)
    samples = (centers.select("cluster_id", F.col("tm").alias("t"), F.col("xm").alias("x"), F.col("ym").alias("y"))
               if use_centres else clusters.select("cluster_id", "t", "x", "y"))
    if p.tracking == "bspline":
        out = fit_splines(samples, p)
        out = fix(cut_lineage(out)) if p.correction else out
        return (_close_gaps(out) if p.correction else out).select(*_COLS)

    pts = kalman.kalman_points(source, p, use_centres)
    if p.tracking == "kalman":
        if p.correction:
            pts = cut_lineage(_close_gaps(fix(cut_lineage(pts))))
        s = kalman.smooth3x2(pts, ["x", "y", "u", "v"])
        return s.select("cluster_id", "seq", "t", "x", "y",
                        *[(F.col(c) * 1e-6).alias(c) for c in ("u", "v")])

    s = cut_lineage(kalman.smooth3x2(pts.select("cluster_id", "seq", "t", "x", "y"), ["x", "y"]))
    if p.tracking == "hybrid_xk_us":
        vel = fit_splines(samples, p, s)
        out = s.join(vel.select("cluster_id", "seq", "u", "v"), ["cluster_id", "seq"])
    else:
        s = _longer_than(s, 2)
        fit = fit_splines(s.select("cluster_id", "t", "x", "y"), p, s)
        if p.tracking == "hybrid_xk_uks":
            out = s.join(fit.select("cluster_id", "seq", "u", "v"), ["cluster_id", "seq"])
        elif p.tracking == "hybrid_xks_uks":
            out = fit
        else:
            raise ValueError(f"unknown tracking method: {p.tracking}")
    out = fix(cut_lineage(out)) if p.correction else out
    return (_close_gaps(out) if p.correction else out).select(*_COLS)
