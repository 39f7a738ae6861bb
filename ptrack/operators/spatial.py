"""Radius joins on the pixel grid and nearest-neighbour matches of slices."""
from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F


def around(cell) -> Column:
    """A grid cell index and its two neighbours."""
    return F.array(cell - 1, cell, cell + 1)


def centre_pixels(centres: DataFrame, r: float, *cols: str) -> DataFrame:
    """Pixels within r (inclusive) of each centre (xm, ym), from a fixed stencil."""
    h = ceil(r)
    span = F.expr(f"sequence({-h}, {h + 1})")
    d2 = F.pow(F.col("x") - F.col("xm"), 2) + F.pow(F.col("y") - F.col("ym"), 2)
    return (centres.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
            .withColumn("x", (F.floor("xm") + F.col("_i")).cast("int"))
            .withColumn("y", (F.floor("ym") + F.col("_j")).cast("int"))
            .where(d2 <= r * r).select("k", "x", "y", *cols))


def radius_counts(centres: DataFrame, counts: DataFrame, r: float, key: str, min_events: int) -> DataFrame:
    """Events within r of each centre of the same slice; ``claimed`` if more than min_events."""
    hit = (centre_pixels(centres, r, key).join(counts.select("k", "x", "y", "n"), ["k", "x", "y"])
           .groupBy("k", key).agg(F.sum("n").alias("events")))
    return (centres.select("k", key).join(hit, ["k", key], "left")
            .withColumn("events", F.coalesce("events", F.lit(0)))
            .withColumn("claimed", F.col("events") > min_events))


def unclaimed(sl: DataFrame, centres: DataFrame, claims: DataFrame, r: float, key: str) -> DataFrame:
    """Events no claiming centre reaches."""
    taken = centre_pixels(centres.join(claims.where("claimed").select("k", key), ["k", key]), r).distinct()
    return sl.join(taken, ["k", "x", "y"], "left_anti")


def match_slices(cl: DataFrame, threshold: float, live: DataFrame | None = None) -> DataFrame:
    """One-to-one links of clusters (k, label, xm, ym) to those of slice k-1.

    Each cluster picks its nearest predecessor closer than ``threshold``; of
    several claimants the closest keeps it, the others start anew. Ties go to
    the lower label. ``live`` restricts the predecessors. Grid cells of the threshold's size make it an equi-join."""
    c = F.floor(F.col("xm") / threshold), F.floor(F.col("ym") / threshold)
    cur = (cl.select("k", "label", "xm", "ym", F.explode(around(c[0])).alias("cx"))
           .select("*", F.explode(around(c[1])).alias("cy")))
    prev = (cl if live is None else live).select((F.col("k") + 1).alias("k"), F.col("label").alias("prev"), F.col("xm").alias("px"),
                     F.col("ym").alias("py"), c[0].alias("cx"), c[1].alias("cy"))
    d = F.sqrt(F.pow(F.col("xm") - F.col("px"), 2) + F.pow(F.col("ym") - F.col("py"), 2))
    # min_by folds candidates as they arrive; no list of pairs is kept
    pick = (cur.join(prev, ["k", "cx", "cy"]).withColumn("d", d).where(F.col("d") < threshold)
            .groupBy("k", "label").agg(F.min(F.struct("d", "prev")).alias("m"))
            .select("k", "label", "m.d", "m.prev"))
    won = (pick.groupBy("k", "prev").agg(F.min(F.struct("d", "label")).alias("m"))
           .select("k", F.col("m.label").alias("label"), "prev", F.col("m.d").alias("dist")))
    return cl.select("k", "label").join(won, ["k", "label"], "left")


def region_overlap(labels: DataFrame, structure: int = 1) -> DataFrame:
    """(k, label, n_prev): regions of slice k-1 sharing a pixel with each region."""
    from ptrack.operators.raster import scatter
    reach = labels
    if structure > 1:
        h = structure // 2
        reach = scatter(labels, [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1)], "label").distinct()
    prev = labels.select((F.col("k") + 1).alias("k"), "x", "y", F.col("label").alias("prev"))
    return (reach.join(prev, ["k", "x", "y"]).select("k", "label", "prev").distinct()
            .groupBy("k", "label").agg(F.count(F.lit(1)).alias("n_prev")))
