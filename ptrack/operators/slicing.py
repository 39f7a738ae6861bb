"""Time slices with both ends closed, overlapping slices and display windows."""
from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F


def time_bounds(ev: DataFrame) -> Column:
    """Struct (t0, t1) of the first and last time, as a one-row subquery."""
    return ev.agg(F.struct(F.min("t").alias("t0"), F.max("t").alias("t1")).alias("b")).scalar()


def slice_count(b: Column, dt: float) -> Column:
    n = F.ceil((b["t1"] - b["t0"]) / dt)
    return F.greatest(n, F.lit(1)).cast("int")


def slice_events(ev: DataFrame, dt: float, overlap: float = 0.0, bounds: Column | None = None,
                 last: bool = True) -> DataFrame:
    """Add (k, is_overlap). Slice k holds [t0 + k dt, t0 + (k+1) dt], so an event
    on an edge is in both; with an overlap slices k > 0 start overlap*dt earlier
    and those early events are flagged."""
    b = time_bounds(ev) if bounds is None else bounds
    t, t0 = F.col("t"), b["t0"]
    base = F.floor((t - t0) / dt)
    k = F.col("k")
    start = t0 + k * dt
    lower = F.when(k > 0, t0 + (k - overlap) * dt).otherwise(start) if overlap else start
    limit = k < slice_count(b, dt) if last else F.lit(True)
    return (ev.withColumn("k", F.explode(F.sequence(base - 1, base + ceil(overlap))))
            .where((k >= 0) & (t >= lower) & (t <= t0 + (k + 1) * dt) & limit)
            .withColumn("is_overlap", t < start)
            .withColumn("k", k.cast("int")))


def display_window(ev: DataFrame, start: Column, dt: float) -> DataFrame:
    """Events in (start, start + dt]."""
    return ev.where((F.col("t") > start) & (F.col("t") <= start + dt))


def shift_window(start: Column, direction: int, dt: float, b: Column) -> Column:
    """Next or previous display window, kept inside the data range."""
    s = F.greatest(start + direction * dt, b["t0"])
    return F.when(s + dt > b["t1"], b["t1"] - dt).otherwise(s)


def half_open_bin(df: DataFrame, width: float, out: str = "bin") -> DataFrame:
    """Plain bins [tmin + i w, tmin + (i+1) w)."""
    t0 = df.agg(F.min("t").alias("m")).scalar()
    return df.withColumn(out, F.floor((F.col("t") - t0) / width).cast("bigint"))
