"""Event filters. All are plain predicates, so they reach the parquet scan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ptrack.params import SENSOR


def _range(col: str, a, b) -> Column:
    lo, hi = min(a, b), max(a, b)
    return F.col(col).between(lo, hi)


def roi(ev: DataFrame, xmin: int, xmax: int, ymin: int, ymax: int) -> DataFrame:
    """Inclusive box; swapped bounds are put right."""
    return ev.where(_range("x", xmin, xmax) & _range("y", ymin, ymax))


def time_crop(ev: DataFrame, tmin: float | None = None, tmax: float | None = None) -> DataFrame:
    """Inclusive time range; swapped bounds are put right, open ends allowed."""
    if tmin is not None and tmax is not None:
        return ev.where(_range("t", tmin, tmax))
    if tmin is not None:
        return ev.where(F.col("t") >= tmin)
    return ev.where(F.col("t") <= tmax) if tmax is not None else ev


def positive(ev: DataFrame) -> DataFrame:
    """Events of positive polarity; a stream without polarity passes whole."""
    return ev.where(F.col("p") > 0) if "p" in ev.columns else ev


def on_sensor(ev: DataFrame, sensor: tuple = SENSOR) -> DataFrame:
    return ev.where(F.col("x").between(0, sensor[0] - 1) & F.col("y").between(0, sensor[1] - 1))


def finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df


def apply_filters(ev: DataFrame, box=None, crop=None, only_positive: bool = True) -> DataFrame:
    if box is not None:
        ev = roi(ev, *box)
    if crop is not None:
        ev = time_crop(ev, *crop)
    return positive(ev) if only_positive else ev


def filter_counts(ev: DataFrame, box=None, crop=None, only_positive: bool = True) -> DataFrame:
    """Kept and total number of events in one pass."""
    keep = F.lit(True)
    if box is not None:
        keep = keep & _range("x", box[0], box[1]) & _range("y", box[2], box[3])
    if crop is not None:
        keep = keep & _range("t", *crop)
    if only_positive:
        keep = keep & (F.col("p") > 0)
    return ev.agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("total"))


def mask_invalid(tracks: DataFrame, ok: str = "ok", cols=("t", "x", "y", "u", "v")) -> DataFrame:
    """Null out the values of points that failed validation."""
    return tracks.select(*[F.when(F.col(ok), F.col(c)).alias(c) if c in cols else F.col(c)
                           for c in tracks.columns])
