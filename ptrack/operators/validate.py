"""Track quality score, neighbourhood filter and their flags."""
from __future__ import annotations

from functools import reduce
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ptrack.functions import robust
from ptrack.functions.ordered import exact_quantiles, quantiles_by, with_halo
from ptrack.operators.slicing import half_open_bin
from ptrack.params import Params
from ptrack.session import cut_lineage, grouped

EPS = 1e-8
# Fixed value: standard deviation of a normal distribution per MAD.
MAD_SIGMA = 1.4826


def track_shape(tracks: DataFrame) -> DataFrame:
    """(cluster_id, angle, velo, path): mean absolute heading change in degrees,
    coefficient of variation of the speed, path length (null below two points)."""
    w = Window.partitionBy("cluster_id", "_c").orderBy("seq")
    d = with_halo(tracks.select("cluster_id", "seq", "x", "y", "u", "v"), "seq", 8192, before=1)
    turn = F.atan2("v", "u") - F.atan2(F.lag("v").over(w), F.lag("u").over(w))
    wrapped = turn - 2 * pi * F.floor((turn + pi) / (2 * pi))
    d = (d.withColumn("turn", F.abs(wrapped))
         .withColumn("leg", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
         .withColumn("speed", F.hypot("u", "v")).where(~F.col("_halo")))
    return d.groupBy("cluster_id").agg(
        F.coalesce(F.avg("turn") * 180 / pi, F.lit(0.0)).alias("angle"),
        (F.stddev_pop("speed") / (F.avg("speed") + EPS)).alias("velo"), F.sum("leg").alias("path"))


def inverse_path(path: Column, ref: float) -> Column:
    return 1.0 / (path / (ref + EPS) + EPS)


def _with_quantiles(d: DataFrame, keys: list[str], wanted: dict, rows: int | None) -> DataFrame:
    """Rows with the quantiles of their keys' values as columns. By keys, the rows are stored
    first: they are read several times, and the plan would hold that many copies of theirs."""
    if not keys:
        m = exact_quantiles(d, wanted, rows)
        return d.select("*", *[F.lit(m[n]).cast("double").alias(n) for n in wanted])
    d = cut_lineage(d)
    m = quantiles_by(d, keys, wanted).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return d.join(m, same, "left").drop(*[f"_{k}" for k in keys])


def quality_terms(shape: DataFrame, q: float, keys: list[str] = []) -> DataFrame:
    """Robust z of each measure, clipped at 0 and divided by its q-quantile, over all
    tracks or over those of each key. ``shape`` must be materialised."""
    names = ("angle", "velo", "inv")
    rows = None if keys else shape.count()
    d = _with_quantiles(shape, keys, {"m_path": ("path", 0.5), "m_angle": ("angle", 0.5), "m_velo": ("velo", 0.5)}, rows)
    d = d.withColumn("inv", inverse_path(F.col("path"), F.coalesce("m_path", F.lit(0.0))))
    d = _with_quantiles(d, keys, {"m_inv": ("inv", 0.5)}, rows)
    d = d.select("*", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(f"dev_{c}") for c in names])
    d = _with_quantiles(d, keys, {f"mad_{c}": (f"dev_{c}", 0.5) for c in names}, rows)
    d = d.select("*", *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"mad_{c}") + EPS)).alias(f"z_{c}") for c in names])
    d = d.select("*", *[F.when(F.col(f"z_{c}").isNotNull(), F.greatest(F.col(f"z_{c}"), F.lit(0.0))).alias(f"c_{c}")
                        for c in names])
    d = _with_quantiles(d, keys, {f"ref_{c}": (f"c_{c}", q) for c in names}, rows)
    return d.select("*", *[(F.col(f"c_{c}") / (F.col(f"ref_{c}") + EPS)).alias(f"q_{c}") for c in names])


def quality(tracks: DataFrame, p: Params, keys: list[str] = []) -> DataFrame:
    """(cluster_id, angle, velo, path, …, score, ok) per track; with keys a track is
    compared with those of the same recording only."""
    shape = track_shape(tracks)
    if keys:
        shape = shape.join(tracks.select("cluster_id", *keys).distinct(), "cluster_id")
    shape = cut_lineage(shape)
    if not shape.limit(1).count():
        return shape.withColumn("score", F.lit(None).cast("double")).withColumn("ok", F.lit(False))
    t = quality_terms(shape, p.quality_quantile, keys)
    score = p.w_angle * F.col("q_angle") + p.w_velo * F.col("q_velo") + p.w_path * F.col("q_inv")
    return (t.withColumn("score", score)
            .withColumn("ok", F.coalesce(~F.isnan("score") & (F.col("score") <= p.quality_threshold), F.lit(False))))


# A tile is this many radii wide; a crowded one is split into parts of so many targets.
TILE_RADII = 8
TILE_TARGETS = 20_000

_STATS = ["n_neighbors", "w_sum", "med_u", "mad_u", "med_v", "mad_v", "med_angle", "mad_angle",
          "comp_dev", "dir_dev"]


def neighborhood(tracks: DataFrame, p: Params) -> DataFrame:
    """Per track point (cluster_id, seq): weighted statistics over points of other
    tracks within the radius in the same time bin, and ``keep``.

    Points are grouped by tiles together with copies from a margin of one radius;
    pairs only exist inside a task, one target at a time. Crowded tiles are split
    by target, and all of their sources go to each part."""
    r, need = p.nb_radius, p.nb_min_neighbors
    side = TILE_RADII * r
    pts = half_open_bin(tracks.select("cluster_id", "seq", "t", "x", "y", "u", "v"), p.nb_dt_factor * p.dt)
    pts = cut_lineage(pts.withColumn("hx", F.floor(F.col("x") / side)).withColumn("hy", F.floor(F.col("y") / side)))
    crowd = pts.groupBy("bin", "hx", "hy").count().where(F.col("count") > TILE_TARGETS)
    crowd = cut_lineage(crowd.select("bin", F.col("hx").alias("tx"), F.col("hy").alias("ty"),
                                     F.ceil(F.col("count") / TILE_TARGETS).cast("bigint").alias("parts")))

    def tiles(c):
        return F.explode(F.sequence(F.floor((F.col(c) - r) / side), F.floor((F.col(c) + r) / side)))
    home = (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy"))
    both = pts.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
    if crowd.limit(1).count():
        parts = F.coalesce("parts", F.lit(1).cast("bigint"))
        both = (both.join(crowd, ["bin", "tx", "ty"], "left")
                .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
                .withColumn("own", home & (F.pmod(F.xxhash64("cluster_id", "seq"), parts) == F.col("part"))))
    else:
        both = both.withColumn("part", F.lit(0).cast("bigint")).withColumn("own", home)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(["cluster_id", "seq"])
        a = s[s.own]
        by_x = np.argsort(s.x.to_numpy(), kind="stable")
        sx, sy, su, sv, sid = (s[c].to_numpy() for c in ("x", "y", "u", "v", "cluster_id"))
        ang = np.arctan2(sv, su)
        lo = np.searchsorted(sx[by_x], a.x.to_numpy() - r, side="left")
        hi = np.searchsorted(sx[by_x], a.x.to_numpy() + r, side="right")
        rows = []
        for cid, q, x, y, u, v, i, j in zip(a.cluster_id, a.seq, a.x, a.y, a.u, a.v, lo, hi):
            c = np.sort(by_x[i:j])
            d2 = (sx[c] - x) ** 2 + (sy[c] - y) ** 2
            ok = (d2 <= r * r) & (sid[c] != cid)
            near, w = c[ok], np.exp(-0.5 * d2[ok] / (r * r))
            if len(near) < need:
                rows.append((cid, q, len(near), w.sum(), *[np.nan] * 6, 0.0, 0.0))
                continue
            out, dev = [], []
            for vals, mine in ((su[near], u), (sv[near], v)):
                med = robust.weighted_median(vals, w)
                mad = robust.weighted_median(np.abs(vals - med), w)
                out += [med, mad]
                dev.append(abs(mine - med) / (MAD_SIGMA * mad) if mad else 0.0)
            med = robust.circular_medoid(ang[near], w)
            mad = robust.weighted_median(np.abs(robust.angle_diff(ang[near], med)), w)
            turn = abs(robust.angle_diff(np.arctan2(v, u), med))
            rows.append((cid, q, len(near), w.sum(), *out, med, mad, max(dev),
                         turn / (MAD_SIGMA * mad) if mad else 0.0))
        return pd.DataFrame(rows, columns=["cluster_id", "seq", *_STATS])

    schema = "cluster_id bigint, seq bigint, n_neighbors bigint, " + ", ".join(f"{c} double" for c in _STATS[1:])
    st = grouped(both, "bin", "tx", "ty", "part").applyInPandas(run, schema)
    st = st.select("cluster_id", "seq", "n_neighbors",
                   *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in _STATS[1:]])
    return (st.withColumn("comp_out", F.col("comp_dev") > p.nb_mad_factor)
            .withColumn("dir_out", F.col("dir_dev") > p.nb_angle_factor)
            .withColumn("keep", ~(F.col("comp_out") | F.col("dir_out"))))


def validate(tracks: DataFrame, p: Params, keys: list[str] = []) -> DataFrame:
    """Tracks with ``ok`` per point (and score, deviations of the filters in use); scores
    are relative to the tracks of the same keys."""
    out, ok = tracks, F.lit(True)
    if p.quality_filter:
        # stored: what reads the tracks more than once would hold the plan of the scores each time
        q = cut_lineage(quality(tracks, p, keys).select("cluster_id", "score", F.col("ok").alias("track_ok")))
        out, ok = out.join(q, "cluster_id"), ok & F.col("track_ok")
    if p.neighborhood_filter:
        nb = neighborhood(tracks, p).select("cluster_id", "seq", "comp_dev", "dir_dev", "keep")
        out, ok = out.join(nb, ["cluster_id", "seq"]), ok & F.col("keep")
    return out.withColumn("ok", ok).drop("track_ok", "keep")


def flag_tracks(checked: DataFrame) -> DataFrame:
    return checked.groupBy("cluster_id").agg(F.bool_or("ok").alias("track_ok"))


def validation_stats(checked: DataFrame) -> DataFrame:
    t = checked.groupBy("cluster_id").agg(F.bool_or("ok").alias("keep"), F.count(F.lit(1)).alias("n"),
                                          F.count_if(~F.col("ok")).alias("bad"))
    return t.agg(F.count_if("keep").alias("kept_tracks"), F.count_if(~F.col("keep")).alias("removed_tracks"),
                 F.sum("bad").alias("bad_points"), F.sum("n").alias("total_points"))


def segments(checked: DataFrame) -> DataFrame:
    """Segments between neighbouring points, valid iff both ends are."""
    w = Window.partitionBy("cluster_id", "_c").orderBy("seq")
    d = with_halo(checked.select("cluster_id", "seq", "ok"), "seq", 8192, after=1)
    return (d.withColumn("next", F.lead("ok").over(w)).where(~F.col("_halo") & F.col("next").isNotNull())
            .select("cluster_id", "seq", (F.col("ok") & F.col("next")).alias("valid")))


def export_table(checked: DataFrame) -> DataFrame:
    """Flat table (t, x, y, u, v, trackid) of valid points; track ids 0, 1, … over
    the tracks that keep a point."""
    from ptrack.functions.ordered import dense_ids
    from ptrack.operators.filters import finite
    good = finite(checked.where("ok"), "t", "x", "y", "u", "v")
    ids = dense_ids(good, "cluster_id", "trackid", F.shiftright("cluster_id", 16))
    return good.join(ids, "cluster_id").select("t", "x", "y", "u", "v", "trackid")
