"""Join the end of one cluster to the start of a later (or earlier) one."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ptrack.functions.chains import close, fits_one_task, in_one_task, lookup, pointer_double
from ptrack.operators.spatial import around
from ptrack.session import cut_lineage


def end_points(clusters: DataFrame, dt: float) -> DataFrame:
    """(cluster_id, ts, te, xs, ys, xe, ye): first and last time, and median
    position within the first and the last dt (strict)."""
    span = clusters.groupBy("cluster_id").agg(F.min("t").alias("ts"), F.max("t").alias("te"))
    c = clusters.join(span, "cluster_id")
    a, b = F.col("t") < F.col("ts") + dt, F.col("t") > F.col("te") - dt

    def med(col, cond):
        return F.percentile(F.when(cond, F.col(col)), 0.5)

    return c.where(a | b).groupBy("cluster_id", "ts", "te").agg(
        med("x", a).alias("xs"), med("y", a).alias("ys"), med("x", b).alias("xe"), med("y", b).alias("ye"))


def centre_end_points(centers: DataFrame) -> DataFrame:
    """The same from the first and last centre of each cluster."""
    c = F.struct("tm", "k", "xm", "ym")
    return (centers.groupBy("cluster_id").agg(F.min(c).alias("a"), F.max(c).alias("b"))
            .select("cluster_id", F.col("a.tm").alias("ts"), F.col("b.tm").alias("te"),
                    F.col("a.xm").alias("xs"), F.col("a.ym").alias("ys"),
                    F.col("b.xm").alias("xe"), F.col("b.ym").alias("ye")))


def candidates(ends: DataFrame, max_dt: float, max_dist: float) -> DataFrame:
    """(target, source, te): sources that end within max_dist of the target's
    start and 0 < |Δt| <= max_dt. Cells in time and space make it an equi-join."""
    tc, xc, yc = (F.floor(F.col(c) / w) for c, w in (("ts", max_dt), ("xs", max_dist), ("ys", max_dist)))
    tgt = ends.select(F.col("cluster_id").alias("target"), "ts", "xs", "ys")
    for name, cell in (("ct", tc), ("cx", xc), ("cy", yc)):
        tgt = tgt.select("*", F.explode(around(cell)).alias(name))
    src = ends.select(F.col("cluster_id").alias("source"), "te", "xe", "ye",
                      F.floor(F.col("te") / max_dt).alias("ct"), F.floor(F.col("xe") / max_dist).alias("cx"),
                      F.floor(F.col("ye") / max_dist).alias("cy"))
    gap = F.abs(F.col("ts") - F.col("te"))
    d2 = F.pow(F.col("xs") - F.col("xe"), 2) + F.pow(F.col("ys") - F.col("ye"), 2)
    return (tgt.join(src, ["ct", "cx", "cy"])
            .where((F.col("source") != F.col("target")) & (gap > 0) & (gap <= max_dt) & (d2 <= max_dist ** 2))
            .select("target", "source", "te"))


def _first_free(cand: dict[str, np.ndarray], order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``one_to_one`` of arrays."""
    o = np.lexsort((*[cand[c] for c in reversed(order)], cand["target"]))
    target, source = cand["target"][o], cand["source"][o]
    won, taken, done = np.zeros(len(o), bool), set(), None
    for i, (t, s) in enumerate(zip(target.tolist(), source.tolist())):
        if t != done and s not in taken:
            won[i] = True
            taken.add(s)
            done = t
    return target[won], source[won]


def one_to_one(cand: DataFrame, order: list[str]) -> DataFrame:
    """Greedy links: targets in ascending order take their first free source.

    Round by round, pairs that are each other's first choice are linked and
    leave; this gives the sequential result without a sequential pass. A short list
    is passed through in one task."""
    cand = cut_lineage(cand)
    short = cand.select("target", "source", *[c for c in order if c != "source"])
    if fits_one_task(short):
        names = short.columns
        return in_one_task(short, lambda *c: _first_free(dict(zip(names, c)), order), "target bigint, source bigint")
    links = cand.select("target", "source").limit(0)
    while cand.limit(1).count():
        first = cand.groupBy("target").agg(F.min(F.struct(*order)).alias("o"))
        by_t = first.select("target", F.col("o.source").alias("source"))
        by_s = cand.groupBy("source").agg(F.min("target").alias("target"))
        won = cut_lineage(by_t.join(by_s, ["target", "source"]))
        links = links.unionByName(won.select("target", "source"))
        cand = cut_lineage(cand.join(won.select("target"), "target", "left_anti")
                           .join(won.select("source"), "source", "left_anti"))
    return links


def _roots(node: np.ndarray, ref: np.ndarray, compat: bool) -> tuple[np.ndarray, np.ndarray]:
    """``resolve`` of arrays."""
    if compat:
        hop = ref > node
        hops = node[hop]
        _, far, _ = close(hops, ref[hop], lookup(hops, ref[hop])[1])
        at, there = lookup(hops, ref)
        return node, np.where(there, far[at], ref) if len(hops) else ref
    _, open_ = lookup(node, ref)
    at, low, ring, span = ref, np.minimum(node, ref), open_, 1
    while span <= len(node) and ring.any():
        to, there = lookup(node, at)
        at, low, ring = (np.where(ring & there, at[to], at), np.where(ring & there, np.minimum(low, low[to]), low),
                         ring & there & ring[to])
        span *= 2
    stays = ring & (node == low)
    node, ref, open_ = node[~stays], np.where(ring, low, ref)[~stays], (open_ & ~ring)[~stays]
    return close(node, ref, open_)[:2]


def resolve(links: DataFrame, compat: bool = False) -> DataFrame:
    """(cluster_id, root) for clusters that move. Chains A <- B <- C end in A;
    with ``compat`` links act once each, in target order, so that a chain is
    only followed while targets increase."""
    links = cut_lineage(links.select("target", "source"))
    if fits_one_task(links):
        return in_one_task(links, lambda target, source: _roots(source, target, compat), "cluster_id bigint, root bigint")
    up = links.select(F.col("source").alias("node"), F.col("target").alias("ref"))
    if not compat:
        nxt = up.select(F.col("node").alias("ref"), F.lit(True).alias("open"))
        nodes = up.join(nxt, "ref", "left").select("node", "ref", F.coalesce("open", F.lit(False)).alias("open"))
        # two clusters may name each other: such a ring stays with its smallest member
        nodes = _break_rings(nodes)
        return pointer_double(nodes).select(F.col("node").alias("cluster_id"), F.col("ref").alias("root"))
    hop = up.where(F.col("ref") > F.col("node"))
    nxt = hop.select(F.col("node").alias("ref"), F.lit(True).alias("open"))
    nodes = hop.join(nxt, "ref", "left").select("node", "ref", F.coalesce("open", F.lit(False)).alias("open"))
    far = pointer_double(nodes).select(F.col("node").alias("ref"), F.col("ref").alias("far"))
    return (up.join(far, "ref", "left")
            .select(F.col("node").alias("cluster_id"), F.coalesce("far", "ref").alias("root")))


def _break_rings(nodes: DataFrame) -> DataFrame:
    """Follow each node for its ring length at most; ring members see their own
    minimum, which becomes the root."""
    walk = nodes.select("node", "ref", "open", F.col("ref").alias("at"), F.least("node", "ref").alias("low"))
    walk = cut_lineage(walk)
    total = walk.count()
    span = 1
    while span <= total and walk.where("open").limit(1).count():
        nxt = walk.select(F.col("node").alias("at"), F.col("at").alias("a2"), F.col("low").alias("l2"),
                          F.col("open").alias("o2"))
        walk = cut_lineage(
            walk.join(nxt, "at", "left")
            .select("node", "ref", F.when(F.col("open"), F.coalesce("o2", F.lit(False))).otherwise(F.lit(False)).alias("open"),
                    F.when(F.col("open"), F.coalesce("a2", "at")).otherwise(F.col("at")).alias("at"),
                    F.when(F.col("open"), F.least("low", F.coalesce("l2", "low"))).otherwise(F.col("low")).alias("low")))
        span *= 2
    # whatever is still open after more steps than nodes runs in a ring
    fixed = nodes.join(walk.select("node", F.col("open").alias("ring"), "low"), "node")
    return (fixed.where(~(F.col("ring") & (F.col("node") == F.col("low"))))
            .select("node", F.when(F.col("ring"), F.col("low")).otherwise(F.col("ref")).alias("ref"),
                    F.when(F.col("ring"), F.lit(False)).otherwise(F.col("open")).alias("open")))


def apply_links(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Move rows to their root cluster."""
    return (df.join(roots, "cluster_id", "left")
            .withColumn("cluster_id", F.coalesce("root", "cluster_id")).drop("root"))
