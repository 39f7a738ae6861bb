"""Session settings and lineage cuts."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ptrack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small shuffles feed CPU-heavy stages here: do not merge them into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="ptrack-ckpt-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor
    does not replay earlier rounds and several readers share one result."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame) -> DataFrame:
    """The same for rows that grow with the events: Parquet in the shared checkpoint folder
    takes a fraction of a checkpoint's bytes, and readers fetch only the columns they use."""
    _ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_ptrack_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ptrack-zip-"), "ptrack"), "zip", root, "ptrack")
    sc.addPyFile(name)
    sc._ptrack_shipped = True


def grouped(df: DataFrame, *keys: str):
    """groupBy for Python group functions. Their cost does not show in shuffle bytes,
    so the partition number is set here and not coalesced by size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)
