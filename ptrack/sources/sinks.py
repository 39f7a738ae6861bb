"""Save and load the results of each stage: parquet tables with their parameters."""
from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ptrack.operators.detect import Detection
from ptrack.operators.filters import mask_invalid
from ptrack.operators.validate import export_table, flag_tracks
from ptrack.params import Params
from ptrack.sources.arrays import EventFile

FORMAT_VERSION = 1


def _save_params(spark: SparkSession, path: str, stage: str, p: Params) -> None:
    meta = {"format_version": FORMAT_VERSION, "stage": stage,
            "saved_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "params": json.loads(p.to_json())}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_params(spark: SparkSession, path: str) -> tuple[Params, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Params.from_json(json.dumps(meta.pop("params"))), meta


def save_events(ev: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Filtered events, as parquet or as npz parts with the keys X, Y, T[, P]."""
    if fmt == "npz":
        ev.sparkSession.dataSource.register(EventFile)
        ev.write.format("event_file").option("compress", "true").mode("append").save(path)
    else:
        ev.write.mode("overwrite").parquet(path)


def save_detection(d: Detection, path: str, p: Params) -> None:
    for name in ("clusters", "centers", "steps"):
        getattr(d, name).write.mode("overwrite").parquet(f"{path}/{name}")
    _save_params(d.clusters.sparkSession, path, "detection", p)


def load_detection(spark: SparkSession, path: str) -> tuple[Detection, Params]:
    p, _ = load_params(spark, path)
    return Detection(*(spark.read.parquet(f"{path}/{n}") for n in ("clusters", "centers", "steps"))), p


def save_tracks(tracks: DataFrame, path: str, p: Params) -> None:
    tracks.write.mode("overwrite").parquet(f"{path}/tracks")
    _save_params(tracks.sparkSession, path, "tracking", p)


def load_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, Params]:
    p, _ = load_params(spark, path)
    return spark.read.parquet(f"{path}/tracks"), p


def save_validated(checked: DataFrame, path: str, p: Params, npz: bool = False) -> None:
    """All tracks with invalid points nulled, track flags, and the flat table."""
    mask_invalid(checked).write.mode("overwrite").parquet(f"{path}/tracks")
    flag_tracks(checked).write.mode("overwrite").parquet(f"{path}/flags")
    flat = export_table(checked)
    if npz:
        flat.sparkSession.dataSource.register(EventFile)
        flat.write.format("event_file").option("compress", "true").mode("append").save(f"{path}/flat_npz")
    else:
        flat.write.mode("overwrite").parquet(f"{path}/flat")
    _save_params(checked.sparkSession, path, "validation", p)
