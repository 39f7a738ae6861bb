"""Structured Streaming front end: closed slices of pixel counts from an event stream."""
from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F

from ptrack.params import Params
from ptrack.schema import EVENTS


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from parquet files as they arrive in a folder."""
    return (spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch)
            .parquet(folder))


def slice_stream(ev: DataFrame, p: Params, t0: float, late_us: float = 0.0) -> DataFrame:
    """(slice_start, k, x, y, n, n_in) per lit pixel, emitted once the watermark says
    that the slice is complete; events later than late_us are dropped.

    A recording's origin t0 is a constant here: a stream has no minimum yet."""
    o = p.overlap if p.method == "pixelwise" else 0.0
    base = F.floor((F.col("t") - t0) / p.dt)
    k, t = F.col("k"), F.col("t")
    sl = (ev.where(F.col("p") > 0 if p.only_positive else F.lit(True))
          .withColumn("k", F.explode(F.sequence(base - 1, base + ceil(o))))
          .where((k >= 0) & (t >= F.when(k > 0, t0 + (k - o) * p.dt).otherwise(F.lit(t0))) & (t <= t0 + (k + 1) * p.dt))
          .withColumn("is_overlap", t < t0 + k * p.dt)
          .withColumn("slice_start", F.timestamp_micros((t0 + k * p.dt).cast("bigint"))))
    # a slice is complete when events of the slice after its end are seen
    wait = ceil((2 * p.dt + late_us) / 1000)
    return (sl.withWatermark("slice_start", f"{wait} milliseconds").groupBy("slice_start", "k", "x", "y")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_overlap")).alias("n_in")))
