"""Load events from any supported file, and look at what is there."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ptrack.sources.arrays import FILE_BITS, EventFile, describe, list_files
from ptrack.sources.columns import from_positions, to_events

TABLES = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json"}
ARRAYS = (".npz", ".npy", ".mat", ".raw")


def read_events(spark: SparkSession, path: str, fmt: str | None = None, compat_float32: bool = False) -> DataFrame:
    """Events (event_idx, x, y, t, p) from npz, npy, mat or raw files, or from a
    parquet, orc, csv or json table whose columns are found by name."""
    ext = f".{fmt}" if fmt else os.path.splitext(path.rstrip("/*"))[1].lower()
    if ext in TABLES:
        r = spark.read.option("header", True).option("inferSchema", True) if ext == ".csv" else spark.read
        df = r.format(TABLES[ext]).load(path)
        return to_events(_numbered(df) if ext == ".parquet" else df, compat_float32)
    if ext not in ARRAYS:
        raise ValueError(f"unsupported event format: {ext or path}")
    spark.dataSource.register(EventFile)
    layout = describe(list_files(path)[0])
    df = spark.read.format("event_file").option("compat_float32", str(compat_float32).lower()).load(path)
    return from_positions(df, layout["width"], compat_float32) if "width" in layout else df


def _numbered(df: DataFrame) -> DataFrame:
    """event_idx from the place of a row in its file and of the file among all: the same
    however the files are split, and filters still reach the scan."""
    if "event_idx" in df.columns:
        return df
    files = df.select(F.col("_metadata.file_path").alias("__file")).distinct()
    files = files.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("bigint").alias("__number"))
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.join(files, "__file").withColumn("event_idx", F.shiftleft("__number", FILE_BITS).bitwiseOR(F.col("__row")))


def limit_duration(ev: DataFrame, max_us: float) -> DataFrame:
    """Events of the first max_us of a recording, end included."""
    return ev.where(F.col("t") <= ev.agg(F.min("t")).scalar() + max_us)


def convert(spark: SparkSession, src: str, folder: str, max_us: float = 1e6, fmt: str = "npz") -> None:
    """Copy the first max_us of a recording to npz parts or parquet."""
    ev = limit_duration(read_events(spark, src), max_us)
    if fmt == "npz":
        ev.write.format("event_file").mode("append").save(folder)
    else:
        ev.write.parquet(folder)


def preview(df: DataFrame) -> DataFrame:
    """(column, type, n, lo, hi): one row per column, from a single pass."""
    aggs = [a for c in df.columns for a in (F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"),
                                            F.max(c).cast("double").alias(f"hi_{c}"))]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("n"),
                     F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c, t in df.dtypes]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def event_summary(ev: DataFrame) -> DataFrame:
    """Count, duration, polarity counts and smallest enclosing sensor of a recording."""
    return ev.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("duration"),
                  F.count_if(F.col("p") > 0).alias("n_pos"), F.count_if(F.col("p") <= 0).alias("n_neg"),
                  (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
