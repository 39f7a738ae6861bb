"""Smoothing-spline tracks.

Spark reduces the events of a cluster to one row of moments per time cell and
one moving mean per grid point; only those rows, a few per slice, reach the
fit of a cluster."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ptrack.functions.smoothing import BOX_MARGIN, MOMENTS, CellSpline, choose_fit, smoothing_ladder
from ptrack.params import Params
from ptrack.session import grouped


def median_per_time(samples: DataFrame) -> DataFrame:
    """One sample (cluster_id, t, x, y) per time stamp."""
    return samples.groupBy("cluster_id", "t").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))


def fit_grid(med: DataFrame, step: float) -> DataFrame:
    """Grid points (cluster_id, seq, t = seq * step) from the first sample up to, but
    not at, the last."""
    span = med.groupBy("cluster_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    g0, g1 = F.ceil(F.col("a") / step), F.ceil(F.col("b") / step) - 1
    return (span.where(g1 >= g0).select("cluster_id", F.explode(F.sequence(g0.cast("bigint"), g1.cast("bigint"))).alias("seq"))
            .withColumn("t", F.col("seq") * step))


def near_points(samples: DataFrame, points: DataFrame, dt: float) -> DataFrame:
    """Samples strictly within dt/2 of each point (cluster_id, seq, t as tq), as an
    equi-join on time bins of width dt. A point sees two bins at most."""
    b = F.floor(F.col("t") / dt)
    lo, hi = F.floor((F.col("tq") - dt / 2) / dt), F.floor((F.col("tq") + dt / 2) / dt)
    pts = points.withColumnRenamed("t", "tq").withColumn("_b", F.explode(F.sequence(lo, hi)))
    return (samples.withColumn("_b", b).join(pts, ["cluster_id", "_b"])
            .where((F.col("t") > F.col("tq") - dt / 2) & (F.col("t") < F.col("tq") + dt / 2)).drop("_b"))


def binned_mean(med: DataFrame, points: DataFrame, dt: float) -> DataFrame:
    """(cluster_id, seq, t, mx, my): mean of the samples around each point. A point
    that only sees the cluster's first sample counts as empty."""
    first = med.groupBy("cluster_id").agg(F.min("t").alias("t_first"))
    near = near_points(med.select("cluster_id", "t", "x", "y"), points.select("cluster_id", "seq", "t"), dt)
    m = (near.join(first, "cluster_id").groupBy("cluster_id", "seq")
         .agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.bool_or(F.col("t") > F.col("t_first")).alias("ok"))
         .where("ok").drop("ok"))
    return points.join(m, ["cluster_id", "seq"], "left")


def cell_moments(med: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """Moments of the samples per cell of one step; cell borders fall on the points."""
    origin = points.groupBy("cluster_id").agg((F.min("t") - F.floor(F.min("t") / step) * step).alias("o"))
    pos = (F.col("t") - F.col("o")) / step
    s = (med.join(origin, "cluster_id").withColumn("g", F.floor(pos)).withColumn("tau", pos - F.floor(pos)))
    pw = lambda i: F.pow("tau", F.lit(float(i))) if i else F.lit(1.0)
    sums = [F.array(*[F.sum(pw(i)) for i in range(MOMENTS)]).alias("s"),
            F.array(*[F.sum(F.col("x") * pw(i)) for i in range(4)]).alias("sx"),
            F.array(*[F.sum(F.col("y") * pw(i)) for i in range(4)]).alias("sy"),
            F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.max("o").alias("o")]
    return s.groupBy("cluster_id", "g").agg(*sums)


def fit_splines(samples: DataFrame, p: Params, points: DataFrame | None = None) -> DataFrame:
    """(cluster_id, seq, t, x, u, y, v) at the points, or at the grid of each
    cluster; velocities in px/µs. Clusters with fewer than four time stamps have
    no fit."""
    step = p.step
    med = median_per_time(samples)
    if points is None:
        points = fit_grid(med, step)
    points = points.select("cluster_id", "seq", "t")
    cells = cell_moments(med, points, step)
    means = binned_mean(med, points, p.dt)
    none = lambda t: F.lit(None).cast(t)
    both = (cells.select("cluster_id", "g", "s", "sx", "sy", "xx", "yy", "x0", "x1", "y0", "y1", "o",
                         none("bigint").alias("seq"), none("double").alias("t"), none("double").alias("mx"),
                         none("double").alias("my"))
            .unionByName(means.select("cluster_id", none("bigint").alias("g"),
                                      *[none("array<double>").alias(c) for c in ("s", "sx", "sy")],
                                      *[none("double").alias(c) for c in ("xx", "yy", "x0", "x1", "y0", "y1", "o")],
                                      "seq", "t", "mx", "my")))
    ladder, target = smoothing_ladder(), p.target_rms

    def run(key, pdf):
        pts = pdf[pdf.seq.notna()].sort_values("seq")
        c = pdf[pdf.g.notna()].sort_values("g")
        out = pd.DataFrame({"cluster_id": [], "seq": [], "t": [], "x": [], "u": [], "y": [], "v": []})
        if not len(pts) or not len(c):
            return out
        pos = (pts.t.to_numpy() - c.o.iloc[0]) / step
        # the ladder is tried on the samples before the last point
        head = c[c.g < round(pos[-1])]

        def spline(d):
            mat = lambda n: np.vstack(d[n].to_numpy())
            return CellSpline(d.g, mat("s"), mat("sx"), mat("sy"), d.xx, d.yy)
        count = lambda d: d.s.map(lambda a: a[0]).sum()
        if count(head) < 3 or count(c) < 4:
            return out
        s = ladder[0]
        try:
            if count(head) >= 4:
                box = (int(head.x0.min()) - BOX_MARGIN, int(head.x1.max()) + BOX_MARGIN,
                       int(head.y0.min()) - BOX_MARGIN, int(head.y1.max()) + BOX_MARGIN)
                s = choose_fit(spline(head), pos, pts[["mx", "my"]].to_numpy(float), box, target, ladder)
            f = spline(c)
        except np.linalg.LinAlgError:
            return out
        coef = f.fit(s)
        x, u = f.at(coef, pos), f.at(coef, pos, 1) / step
        return pd.DataFrame({"cluster_id": int(key[0]), "seq": pts.seq.astype("int64"), "t": pts.t,
                             "x": x[:, 0], "u": u[:, 0], "y": x[:, 1], "v": u[:, 1]})

    return grouped(both, "cluster_id").applyInPandas(
        run, "cluster_id bigint, seq bigint, t double, x double, u double, y double, v double")
