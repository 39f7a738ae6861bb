"""Helpers of the corpus operators: tables, shared folders, files that all executors see."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ptrack.session import _ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a stage whose cost does not show in shuffle bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder, which every executor sees."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and is smaller on disk than a checkpoint."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df, a stored table of a few short columns, to be broadcast if it has at most so many
    rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list, groups=(), name: str = "number") -> DataFrame:
    """df with a number from 0, gapless within each combination of the groups (not null), in the
    given order; rows alike in it come in any order. Rows are sorted in ranges, which rows alike in the order do
    not bind together, and a row's place in its range is corrected by counts of (range, group)."""
    spark, groups = df.sparkSession, list(groups)
    tie = F.monotonically_increasing_id()
    ranged = (df.withColumn("__tie", tie).repartitionByRange(parts(spark), *order, "__tie").sortWithinPartitions(*groups, *order, "__tie").drop("__tie")
              .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn("__range", F.spark_partition_id()))
    ranged = stored(ranged, "ranges")
    per = ranged.groupBy("__range", *groups).agg(F.count(F.lit(1)).alias("n"))
    lower = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and group
    inside = lower(Window.partitionBy("__range").orderBy(*groups)) if groups else F.lit(0)
    shift = stored(per.select("__range", *groups, (lower(Window.partitionBy(*(groups or [F.lit(1)])).orderBy("__range")) - inside).alias("__shift")), "range-counts")
    return ranged.join(small(shift), ["__range", *groups]).withColumn(name, F.col("__place") + F.col("__shift")).drop("__range", "__place", "__shift")


def file_system(uri: str):
    """(file system, path) of a shared URI, inside a task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, chunks, attempt: str) -> None:
    """Write under the attempt's own name, then rename: a task that runs again or
    twice leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        for c in chunks:
            out.write(c)
    fs.move(f"{path}.{attempt}", path)


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def drop_file(uri: str) -> None:
    """Delete a file that this run wrote and has read."""
    fs, path = file_system(uri)
    fs.delete_file(path)


# --- arrays as bytes ----------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest value needs; the
    high planes of sorted differences compress well in the shuffle."""
    a = np.ascontiguousarray(a, dtype="<u8")
    w = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([w]) + a.view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    w = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(w, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :w] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    a = np.asarray(a, dtype=np.uint64)
    return pack(np.diff(a, prepend=a[:1] * np.uint64(0))) if len(a) else pack(a)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_kept: dict = {}


def kept(name, make):
    """What a worker process remembers for one kind of task, e.g. hashes of words. Workers
    live on: a task of another kind makes them forget it, so that memory does not add up."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            released()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """At the end of a task, where the work that follows needs a worker's memory for itself."""
    _kept.clear()
    released()


def released() -> None:
    """Hand freed memory back to the machine, where its C library can do so."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list:
    """Words of a text with A-Z in lower case: bytes.lower and bytes.split know
    ASCII letters and the blanks 0x20, 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# --- components ---------------------------------------------------------------

EDGES = StructType([StructField("a", LongType()), StructField("b", LongType())])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is the
    least node that links reach. Alternates the large-star and small-star steps, so
    the rounds grow with the logarithm of the size; minima are combined before the
    shuffle and hubs meet their neighbours in a join that can be split."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    digest = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = stored(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(down, "a").select(F.col("b").alias("x"), "a", "m")
                       .select(F.explode(F.array("x", "a")).alias("a"), F.col("m").alias("b"))
                       .where("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError("links did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
