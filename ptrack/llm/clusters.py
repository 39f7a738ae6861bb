"""Centroid clustering over zone maps in Hilbert order.

Vectors of whole numbers are sorted along a Hilbert curve through their leading principal
directions and cut into blocks; a block keeps the least and greatest value of each component.
A centroid's least distance to that box, set against the smallest of all greatest distances,
tells whether it can be nearest to anything in the block. Only the centroids that can are
compared with the block's vectors, exactly and as arrays. Rounds read the blocks, which are
written once, and return sums for each centroid, so only centroids move."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ptrack.llm.common import parts, stored

CENTROIDS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SEED = "2"
BLOCK = 64                           # small blocks have small boxes; a box costs about as much as ten exact comparisons
CURVE_DIRECTIONS, CURVE_BITS = 8, 7
MOST = 1 << 26                       # greatest component: squared distances of 64 components stay below 2^61
EXACT = 1 << 22                      # up to here products of doubles are exact

BLOCK_FIELDS = pa.schema([("ids", pa.list_(pa.int64())), ("lo", pa.binary()), ("hi", pa.binary()), ("vectors", pa.binary())])


# --- Hilbert order ----------------------------------------------------------------

def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (whole numbers below 2^bits) on a Hilbert curve through all
    columns. The cells' axes are exchanged and turned bit by bit from the top, then Gray-decoded
    (Skilling, "Programming the Hilbert curve", 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | ((x[i] >> b) & 1)
    return place


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    v = np.floor(scale * vectors)
    if len(v) and np.abs(v).max() > MOST:
        raise ValueError(f"components beyond {MOST} have squared distances that no long holds")
    return v.astype(np.int64)


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def curve(vectors: DataFrame, dim: int, scale: int) -> tuple:
    """(mean, directions, spreads) from the moments of all vectors; tasks return sums."""
    def moments(batches):
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            v = whole(matrix(b.column(0), dim), scale).astype(np.float64)
            v = np.column_stack([np.ones(len(v)), v])
            total += v.T @ v
        at = np.arange(total.size)
        yield pa.RecordBatch.from_pydict({"at": at, "v": total.ravel()})

    total = np.zeros((dim + 1) ** 2)
    for r in vectors.select("embedding").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r.at] = r.v                                    # (dim + 1)^2 rows
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    values, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    k = min(CURVE_DIRECTIONS, dim)
    return mean, axes[:, ::-1][:, :k], np.sqrt(np.maximum(values[::-1][:k], 1e-12))


def blocks_of(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vectors (vec_id, embedding) as a stored table of blocks: ids, the vectors as 32-bit whole
    numbers, and their box."""
    mean, axes, spread = curve(vectors, dim, scale)
    size = 1 << CURVE_BITS

    def place(batches):
        for b in batches:
            v = whole(matrix(b.column(1), dim), scale)
            cells = np.clip(((v - mean) @ axes / spread / 6 + 0.5) * size, 0, size - 1)      # three spreads to either side
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(cells, CURVE_BITS)), b.column(0), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())], names=["place", "vec_id", "v"])

    def block(batches):
        ids, held = [], []

        def row(m):
            v = np.frombuffer(b"".join(held[:m]), "<i4").reshape(m, dim)
            out = pa.RecordBatch.from_arrays([pa.array([ids[:m]], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in (v.min(0), v.max(0), v)]], schema=BLOCK_FIELDS)
            del ids[:m], held[:m]
            return out

        for b in batches:
            ids += b.column(0).to_pylist()
            held += b.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield row(BLOCK)
        if ids:
            yield row(len(ids))

    sorted_ = (vectors.select("vec_id", "embedding").mapInArrow(place, "place long, vec_id long, v binary").withColumn("tie", F.monotonically_increasing_id())
               .repartitionByRange(parts(vectors.sparkSession), "place", "tie").sortWithinPartitions("place", "tie"))
    return stored(sorted_.select("vec_id", "v").mapInArrow(block, "ids array<long>, lo binary, hi binary, vectors binary"), "blocks")


# --- assignment -------------------------------------------------------------------

def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, in ascending order.
    One whose least distance equals the bound stays, so that ties are decided by number."""
    least = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    most = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the nearest centroid, squared distance), exact; ties go to the first."""
    kind = np.float64 if max(np.abs(v).max(), np.abs(centroids).max()) <= EXACT else np.int64
    x, c = v.astype(kind), centroids.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def assigned(row: dict, centroids: np.ndarray, dim: int) -> tuple:
    """(vectors, cluster, squared distance) of a block."""
    lo, hi, v = (np.frombuffer(row[k], "<i4").astype(np.int64) for k in ("lo", "hi", "vectors"))
    v = v.reshape(-1, dim)
    near = candidates(lo, hi, centroids)
    at, d = nearest(v, centroids[near])
    return v, near[at], d


def moved(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round: floored means of their vectors; empty ones stay."""
    k = len(centroids)
    names = [f"s{j}" for j in range(dim)]

    def sums(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for row in b.to_pylist():
                v, cluster, _ = assigned(row, centroids, dim)
                for c in np.unique(cluster):
                    own = cluster == c
                    n[c] += own.sum()
                    total[c] += v[own].sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *[pa.array(total[at, j]) for j in range(dim)]], names=["c", "n", *names])

    # the task sums are added as exact decimals; a row for each centroid
    rows = blocks.select("lo", "hi", "vectors").mapInArrow(sums, "c long, n long, " + ", ".join(f"{s} long" for s in names))
    out = centroids.copy()
    for r in rows.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(28,0)")).alias(s) for s in names]).collect():
        out[r.c] = [int(r[s]) // r.n for s in names]
    return out


def first_centroids(vectors: DataFrame, count: int, scale: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the least hashes; equal hashes go by the vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(h.alias("h"), "embedding").orderBy("h", "embedding").limit(count).collect()
    return whole(np.array([r.embedding for r in rows]), scale) if rows else np.zeros((0, 0), np.int64)


def clusters(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of
    `vectors` (vec_id, embedding) with exactly `dim` components, none null or not finite; others
    are left out. Components become floor(scale * x); beyond `MOST` that is an error.

    Repeated rows are vectors of their own, also among the first centroids. A vector without an
    id is clustered, but is no first centroid. With fewer vectors than `count` there are fewer
    centroids; a table without vectors gives no rows. Other columns are not read."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    ok = F.coalesce((F.size(e) == dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    good = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(ok)
    centroids = first_centroids(good, count, scale, seed)
    fields = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return (good.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"),
                            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")).limit(0))
    blocks = blocks_of(good, dim, scale)
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dim)

    def last(batches):
        for b in batches:
            for row in b.to_pylist():
                _, cluster, d = assigned(row, centroids, dim)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    found = stored(blocks.mapInArrow(last, fields), "assigned")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # a row for each centroid
    per = spark.createDataFrame([(c, d, sum(inertia.values()), names[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
