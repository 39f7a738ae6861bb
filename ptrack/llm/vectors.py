"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random lines. Two unit vectors at the least cosine differ by
a normal value of known spread on each line, so the share of lines on which one falls in the
window around the other is binomial: the count from which a pair is checked is the one that
a true pair misses with a chance of `miss` at most. Counting and checking are done for pairs
of blocks: vectors of one label, sorted by their place on a fixed unit line, in blocks of
bounded size. No pair of the least cosine lies further apart on that line than the length
of its difference, so blocks further apart do not meet."""
from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ptrack.llm.common import components, parts, stored

LINES = 32
WINDOW = 2.2                         # half the window, in spreads of a pair at the least cosine
BLOCK = 1024
BLOCKS = "label string, dim int, block string, lo double, hi double, n int, rows binary, many binary, vectors binary"


def least_count(miss: float = 1e-6, lines: int = LINES, window: float = WINDOW) -> int:
    """The count of collisions that a pair at the least cosine reaches but for a chance of `miss`."""
    p, below = erf(window / sqrt(2)), 0.0
    for k in range(lines + 1):
        below += comb(lines, k) * p ** k * (1 - p) ** (lines - k)
        if below > miss:
            return k
    return lines


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lines_of(dim: int, n: int = LINES) -> np.ndarray:
    return np.random.default_rng(20 + dim).standard_normal((dim, n))


def sort_line(dim: int) -> np.ndarray:
    a = np.random.default_rng(7 + dim).standard_normal(dim)
    return a / np.linalg.norm(a)


def near(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of unit vectors with at least this cosine, i < j if same."""
    a = lines_of(x.shape[1])
    w = WINDOW * sqrt(2 - 2 * cosine)
    p, q = x @ a, y @ a
    hits = np.zeros((len(x), len(y)), np.uint8)
    for j in range(a.shape[1]):
        order = np.argsort(q[:, j])
        values = q[order, j]
        lo, hi = np.searchsorted(values, p[:, j] - w), np.searchsorted(values, p[:, j] + w, side="right")
        for i, (s, e) in enumerate(zip(lo.tolist(), hi.tolist())):
            hits[i, order[s:e]] += 1
    i, j = np.nonzero(hits >= least)
    if same:
        i, j = i[i < j], j[i < j]
    found = [((x[i[s:s + 65536]] * y[j[s:s + 65536]]).sum(axis=1) >= cosine) for s in range(0, len(i), 65536)]
    ok = np.concatenate(found) if found else np.zeros(0, bool)
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each member's component among n."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(vectors: DataFrame, cosine: float = 0.93, miss: float = 1e-6) -> DataFrame:
    """vec_id, embedding (array of numbers), label -> vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double
    precision, is at least `cosine`. Vectors that are null, empty or zero, or hold null or
    non-finite values, link with nothing; nor do vectors of different lengths. Rows that
    repeat a vec_id are vectors of their own. Equal vectors are compared once."""
    e = F.col("embedding")
    ok = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
                    & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = stored(vectors.select("vec_id", F.col("label").cast("string").alias("label"), e.cast("array<double>").alias("embedding"),
                                 F.monotonically_increasing_id().alias("row"))
                  .withColumn("h1", F.when(ok, F.xxhash64("embedding"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit(1), "embedding"))), "vectors")
    distinct = (rows.where("h1 is not null").groupBy("label", "h1", "h2")
                .agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("many"), F.first("embedding").alias("embedding"))
                .withColumn("dim", F.size("embedding")))

    def project(batches):
        for b in batches:
            place = np.zeros(len(b))
            for dim in b["dim"].unique():
                at = np.flatnonzero(b["dim"] == dim)
                place[at] = unit(np.stack(b["embedding"].iloc[at].to_list())) @ sort_line(int(dim))
            yield b.assign(place=place)

    def block(batches):
        from pyspark import TaskContext
        part, k, held, key = TaskContext.get().partitionId(), 0, [], None

        def row():
            d = pd.concat(held)
            return {"label": key[0], "dim": key[1], "block": f"{part:08d}-{k:08d}", "lo": d["place"].min(), "hi": d["place"].max(), "n": len(d),
                    "rows": d["row"].to_numpy(np.int64).tobytes(), "many": d["many"].to_numpy(np.int64).tobytes(),
                    "vectors": np.stack(d["embedding"].to_list()).tobytes()}

        for b in batches:
            for own, g in b.groupby(["label", "dim"], sort=False):
                while len(g):
                    size = sum(map(len, held))
                    if held and (own != key or size >= BLOCK):
                        yield pd.DataFrame([row()])
                        k, held, size = k + 1, [], 0
                    key = own
                    held.append(g.iloc[:BLOCK - size])
                    g = g.iloc[BLOCK - size:]
        if held:
            yield pd.DataFrame([row()])

    fields = "label string, h1 long, h2 long, row long, many long, embedding array<double>, dim int"
    blocks = stored(distinct.mapInPandas(project, f"{fields}, place double").repartitionByRange(parts(vectors.sparkSession), "label", "dim", "place")
                    .sortWithinPartitions("label", "dim", "place").mapInPandas(block, BLOCKS), "blocks")
    reach = sqrt(2 - 2 * cosine) + 1e-9
    a, b = blocks.alias("a"), blocks.alias("b")
    meet = (blocks.select("label", "dim", "block", "lo", "hi").alias("a").join(
        blocks.select("label", "dim", "block", "lo", "hi").alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
        & (F.col("a.block") <= F.col("b.block")) & (F.col("b.lo") <= F.col("a.hi") + reach) & (F.col("a.lo") <= F.col("b.hi") + reach))
        .select(F.col("a.block").alias("one"), F.col("b.block").alias("two")))
    least = least_count(miss)

    def compare(batches):
        for b in batches:
            for r in b.itertuples():
                x = unit(np.frombuffer(r.va).reshape(-1, r.dim))
                y = unit(np.frombuffer(r.vb).reshape(-1, r.dim))
                same = r.one == r.two
                i, j = near(x, y, same, cosine, least)
                if not len(i):
                    continue
                j = j if same else j + len(x)
                ids = np.frombuffer(r.ra, np.int64) if same else np.concatenate([np.frombuffer(r.ra, np.int64), np.frombuffer(r.rb, np.int64)])
                many = np.frombuffer(r.ma, np.int64) if same else np.concatenate([np.frombuffer(r.ma, np.int64), np.frombuffer(r.mb, np.int64)])
                n = np.zeros(len(ids), np.int64)
                np.add.at(n, i, many[j])
                np.add.at(n, j, many[i])
                hit = np.flatnonzero(n)
                yield pd.DataFrame({"row": ids[hit], "n": n[hit], "root": ids[forest(len(ids), i, j)[hit]]})

    pairs = (meet.join(a.select(F.col("block").alias("one"), "dim", F.col("rows").alias("ra"), F.col("many").alias("ma"), F.col("vectors").alias("va")), "one")
             .join(b.select(F.col("block").alias("two"), F.col("rows").alias("rb"), F.col("many").alias("mb"), F.col("vectors").alias("vb")), "two")
             .repartition(4 * parts(vectors.sparkSession), "one", "two"))
    links = stored(pairs.mapInPandas(compare, "row long, n long, root long"), "vector-links")
    per = links.groupBy("row").agg(F.sum("n").alias("n"))
    comp = components(links.select(F.col("row").alias("a"), F.col("root").alias("b")))
    # back from distinct vectors to all rows
    key = ["label", "h1", "h2"]
    found = (distinct.select(*key, "row", "many").join(per, "row", "left").join(comp.withColumnRenamed("node", "row"), "row", "left")
             .select(*key, (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "row").alias("component")))
    whole = rows.select("vec_id", "row", *key).join(found, key, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row").alias("component"))
    whole = stored(whole, "vector-classes")
    least_id = whole.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return (whole.join(least_id, "component").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                                                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))
