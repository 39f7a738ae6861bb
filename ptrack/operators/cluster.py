"""Connected components and density clusters of a slice.

A slice has at most one row per sensor pixel after ``pixel_counts``, which
bounds the group handed to one task; slices run in parallel."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ptrack.functions import pixels as px
from ptrack.operators.filters import on_sensor
from ptrack.operators.raster import above_threshold, disc_filter, otsu
from ptrack.params import SENSOR
from ptrack.session import cut_lineage, grouped


def label_regions(frame: DataFrame, connectivity: int = 4, structure: int = 1) -> DataFrame:
    """(k, x, y, label): labels in raster order, x major, from 1 per slice.
    With a structure > 1 the dilated pixels are labelled and returned."""
    half = px.HALF4 if connectivity == 4 else px.HALF8

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = px.dilate(np.unique(px.code(pdf.x, pdf.y)), structure)
        return pd.DataFrame({"k": int(pdf.k.iloc[0]), "x": c // px.STRIDE, "y": c % px.STRIDE,
                             "label": px.label(c, half)})

    return grouped(frame.select("k", "x", "y"), "k").applyInPandas(run, "k int, x int, y int, label bigint")


def region_sizes(labels: DataFrame, counts: DataFrame, min_size: int) -> DataFrame:
    """Regions that pass the size rule: lit (dilated) pixels in slice 0, events later."""
    r = (labels.join(counts.select("k", "x", "y", "n"), ["k", "x", "y"], "left")
         .groupBy("k", "label").agg(F.count(F.lit(1)).alias("pixels"),
                                    F.coalesce(F.sum("n"), F.lit(0)).alias("events")))
    size = F.when(F.col("k") == 0, F.col("pixels")).otherwise(F.col("events"))
    return r.where(size >= min_size)


def dbscan_core(counts: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(k, x, y, n, neighbours, core): events within eps of each lit pixel, from a fixed
    stencil; no pairs of events are formed, and a group holds one slice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = px.code(pdf.x, pdf.y)
        o = np.argsort(c)
        out = pdf[["k", "x", "y", "n"]].iloc[o].copy()
        out["neighbours"] = px.events_in_reach(c[o], out.n.to_numpy(np.int64), eps)
        out["core"] = out.neighbours >= min_pts
        return out

    return (grouped(counts.select("k", "x", "y", "n"), "k")
            .applyInPandas(run, "k int, x int, y int, n bigint, neighbours bigint, core boolean"))


def dbscan(counts: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(k, x, y, n, label) with label -1 for noise, see functions.pixels.dbscan."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = px.code(pdf.x, pdf.y)
        o = np.argsort(c)
        first = np.empty(len(c), np.int64)
        first[np.lexsort((pdf.first_idx, pdf.first_t))] = np.arange(len(c))
        n = pdf.n.to_numpy()
        out = pdf[["k", "x", "y", "n"]].iloc[o].copy()
        out["label"] = px.dbscan(c[o], n[o], first[o], eps, min_pts)
        return out

    return (grouped(counts.select("k", "x", "y", "n", "first_t", "first_idx"), "k")
            .applyInPandas(run, "k int, x int, y int, n bigint, label bigint"))


def cluster_medians(sl: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, label, xm, ym, tm, events): medians over the events of each cluster.
    Medians keep value counts, of which there are at most sensor size / slice µs."""
    return (sl.join(labels.where("label >= 0").select("k", "x", "y", "label"), ["k", "x", "y"])
            .groupBy("k", "label")
            .agg(F.percentile("x", 0.5).alias("xm"), F.percentile("y", 0.5).alias("ym"),
                 F.percentile("t", 0.5).alias("tm"), F.count(F.lit(1)).alias("events")))


def smooth_frame(frame: DataFrame, radius: int, sensor: tuple = SENSOR) -> DataFrame:
    """Pixels above Otsu's threshold of the disc-filtered frame."""
    frame = cut_lineage(frame)
    return above_threshold(frame, otsu(disc_filter(frame, radius, sensor), sensor=sensor), radius, sensor)


def region_props(labels: DataFrame) -> DataFrame:
    """(k, label, area, xm, ym) with centroids as member means."""
    return labels.groupBy("k", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("xm"), F.avg("y").alias("ym"))


def frame_centroids(frame: DataFrame, radius: int = 3, area: int = 5, sensor: tuple = SENSOR):
    """Pseudo-frame detection: (labels, props) of regions with more than ``area`` pixels."""
    labels = label_regions(smooth_frame(on_sensor(frame, sensor), radius, sensor), connectivity=8)
    return labels, region_props(labels).where(F.col("area") > area)
