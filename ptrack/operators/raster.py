"""Sparse pseudo-frames: distinct lit pixels per slice and stencils on them.

Every result is keyed by (k, x, y). Counting events per pixel first bounds a
slice by the number of sensor pixels, however many events it holds."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ptrack.functions import pixels as px
from ptrack.functions.pixels import STRIDE
from ptrack.operators.filters import on_sensor
from ptrack.params import SENSOR
from ptrack.session import cut_lineage, grouped


def pixel_counts(sl: DataFrame) -> DataFrame:
    """(k, x, y, n, n_in, first_t, first_idx): events per lit pixel, of which
    n_in lie in the slice itself, and the first event. All coordinates of 16 bits
    count, on a sensor of any size; others are an error."""
    first = F.min(F.struct("t", "event_idx"))
    flag = F.col("is_overlap") if "is_overlap" in sl.columns else F.lit(False)
    known = F.col("x").between(0, STRIDE - 1) & F.col("y").between(0, STRIDE - 1)
    x = F.when(known, F.col("x")).otherwise(F.raise_error(F.format_string("no pixel: x = %s, y = %s", "x", "y"))).cast("int")
    return (sl.withColumn("x", x).groupBy("k", "x", "y")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(~flag).alias("n_in"), first.alias("_f"))
            .select("k", "x", "y", "n", "n_in", F.col("_f.t").alias("first_t"),
                    F.col("_f.event_idx").alias("first_idx")))


def pseudo_frame(sl: DataFrame, sensor: tuple = SENSOR) -> DataFrame:
    """Lit pixels of each slice: an image of the sensor, without events beyond it."""
    return on_sensor(sl, sensor).select("k", "x", "y").distinct()


def scatter(lit: DataFrame, offsets, *cols: str) -> DataFrame:
    """Copy every pixel to its position plus each offset: a fixed stencil, so the
    output grows linearly with the lit pixels."""
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    return (lit.withColumn("_o", F.explode(o))
            .select("k", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y"), *cols))


def dilate(lit: DataFrame, size: int) -> DataFrame:
    """Dilation with a size x size square, clipped to the sensor."""
    h = size // 2
    off = [(i, j) for i in range(-h, h + 1) for j in range(-h, h + 1)]
    return on_sensor(scatter(lit, off)).distinct()


def disc_filter(frame: DataFrame, radius: int = 3, sensor: tuple = SENSOR) -> DataFrame:
    """Mean of the binary frame over a disc, mirrored at the borders.
    Returns (k, x, y, hits, v) for pixels with a non-zero mean. Only lit pixels are shuffled;
    a group holds one slice."""
    taps = float(len(px.disc(radius)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, hits = px.disc_hits(pdf.x, pdf.y, radius, sensor)
        return pd.DataFrame({"k": int(pdf.k.iloc[0]), "x": x, "y": y, "hits": hits, "v": hits / taps})

    lit = frame.select("k", "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return grouped(lit, "k").applyInPandas(run, "k int, x int, y int, hits int, v double")


def above_threshold(frame: DataFrame, limits: DataFrame, radius: int = 3, sensor: tuple = SENSOR) -> DataFrame:
    """(k, x, y): pixels of the disc-filtered frame above their slice's limit (k, threshold).
    Limits travel as one extra row per group, so neither they nor the filtered pixels are joined."""
    taps = float(len(px.disc(radius)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lit, limit = pdf[pdf.threshold.isna()], pdf.threshold.dropna()
        if not len(lit) or not len(limit):
            return pd.DataFrame({"k": [], "x": [], "y": []})
        x, y, hits = px.disc_hits(lit.x, lit.y, radius, sensor)
        keep = hits / taps > limit.iloc[0]
        return pd.DataFrame({"k": int(pdf.k.iloc[0]), "x": x[keep], "y": y[keep]})

    lit = frame.select("k", "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = lit.unionByName(limits.select("k", "threshold"), allowMissingColumns=True)
    return grouped(rows, "k").applyInPandas(run, "k int, x int, y int")


def otsu(smooth: DataFrame, bins: int = 256, sensor: tuple = SENSOR) -> DataFrame:
    """(k, threshold): Otsu's threshold per slice over the whole frame, dark
    pixels included, from a histogram of ``bins`` equal bins between the
    frame's minimum and maximum; the threshold is a bin centre."""
    total = sensor[0] * sensor[1]
    # the mean takes at most 29 values for radius 3: count them in one pass, the rest is small
    h = cut_lineage(smooth.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    span = h.groupBy("k").agg(F.sum("n").alias("lit"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = span.select("k", "lit", F.when(F.col("lit") < total, 0.0).otherwise(F.col("lo")).alias("lo"), "hi")
    dark = (span.where(F.col("lit") < total)
            .select("k", F.lit(0.0).alias("v"), (total - F.col("lit")).alias("n")))
    width = (F.col("hi") - F.col("lo")) / bins
    hist = (h.unionByName(dark).join(span.select("k", "lo", "hi"), "k").where("hi > lo")
            .withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
            .groupBy("k", "lo", "hi", "bin").agg(F.sum("n").alias("n"))
            .withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins))
    # Empty bins repeat the variance of the last filled one, so filled bins suffice.
    up = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("k")
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("c")).over(up)
    v = (hist.withColumn("w1", w1).withColumn("s1", s1)
         .withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * F.col("c")).over(all_))
         .where(F.col("w1") < F.col("w"))
         .withColumn("var", F.col("w1") * (F.col("w") - F.col("w1"))
                     * F.pow(F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("w") - F.col("w1")), 2)))
    best = v.groupBy("k").agg(F.max_by("c", F.struct("var", -F.col("bin"))).alias("threshold"))
    # a frame of one value has that value as its threshold
    flat = span.where("hi = lo").select("k", F.col("hi").alias("threshold"))
    return best.unionByName(flat)
