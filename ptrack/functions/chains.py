"""Follow predecessor links to their roots in a logarithmic number of rounds."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ptrack.session import cut_lineage, grouped

# A node of slice k with label l is (k << 20) | l; a sensor has fewer than 2^20 pixels.
LABEL_BITS = 20


def node_id(k, label):
    return F.shiftleft(F.col(k).cast("bigint"), LABEL_BITS).bitwiseOR(F.col(label).cast("bigint"))


# A table of links of up to so many rows is followed in one task. Rounds of joins, which follow
# longer ones, leave a driver thread for each of their stages for a minute.
ONE_TASK = 1 << 21


def fits_one_task(links: DataFrame) -> bool:
    """Is a materialised table of links short enough, and without nulls?"""
    has = reduce(Column.__and__, [F.col(c).isNotNull() for c in links.columns])
    n, whole = links.agg(F.count(F.lit(1)), F.count_if(has)).first()
    return n <= ONE_TASK and n == whole


def in_one_task(links: DataFrame, follow: Callable[..., tuple], schema: str) -> DataFrame:
    """follow(*columns of links) -> columns, as arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True)
            del parts
            yield pd.DataFrame(dict(zip(names, follow(*(pdf[c].to_numpy() for c in pdf)))))

    return links.coalesce(1).mapInPandas(run, schema)


def lookup(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in ``nodes`` (which hold it once), and whether it is there."""
    if not len(nodes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    order = np.argsort(nodes)
    at = order[np.minimum(np.searchsorted(nodes, wanted, sorter=order), len(nodes) - 1)]
    return at, nodes[at] == wanted


def close(node: np.ndarray, ref: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pointer_double`` of arrays."""
    ref, open_ = ref.copy(), open_.astype(bool)
    while open_.any():
        o = np.flatnonzero(open_)
        at, there = lookup(node, ref[o])
        ref[o], open_[o] = np.where(there, ref[at], ref[o]), there & open_[at]
    return node, ref, open_


def pointer_double(nodes: DataFrame) -> DataFrame:
    """nodes(node, ref, open): an open ref names another node, a closed one is a
    root. Returns the table with every reachable ref closed."""
    cur = cut_lineage(nodes.select("node", "ref", "open"))
    if fits_one_task(cur):
        return in_one_task(cur, close, "node bigint, ref bigint, open boolean")
    while cur.where("open").limit(1).count():
        nxt = cur.select(F.col("node").alias("ref"), F.col("ref").alias("r2"), F.col("open").alias("o2"))
        cur = cut_lineage(
            cur.where("open").join(nxt, "ref", "left")
            .select("node", F.coalesce("r2", "ref").alias("ref"),
                    F.coalesce("o2", F.lit(False)).alias("open"))
            .unionByName(cur.where("not open")))
    return cur


def slice_chains(links: DataFrame, block: int) -> DataFrame:
    """links(k, label, prev): prev is the label in slice k-1 or null.
    Returns (k, label, cluster_id) with the node id of the chain's first link.

    Chains are followed inside blocks of slices first; pointer doubling then
    only sees the links that cross a block border."""
    links = links.select(F.col("k").cast("bigint"), F.col("label").cast("bigint"),
                         F.col("prev").cast("bigint"), F.floor(F.col("k") / block).alias("blk"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "label"], ignore_index=True)
        k0 = int(pdf.blk.iloc[0]) * block
        k, lab = pdf.k.to_numpy(), pdf.label.to_numpy()
        has = pdf.prev.notna().to_numpy()
        prev = pdf.prev.fillna(0).to_numpy(dtype=np.int64)
        node = (k << LABEL_BITS) | lab
        ref = np.where(has, ((k - 1) << LABEL_BITS) | prev, node)
        open_ = has.copy()
        for kk in np.unique(k):
            if kk == k0:
                continue
            m = np.flatnonzero((k == kk) & has)
            at = np.searchsorted(node, ref[m])
            ref[m], open_[m] = ref[at], open_[at]
        return pd.DataFrame({"k": k, "label": lab, "node": node, "ref": ref, "open": open_})

    part = cut_lineage(grouped(links, "blk").applyInPandas(
        inside, "k bigint, label bigint, node bigint, ref bigint, open boolean"))
    border = pointer_double(part.where(F.pmod("k", F.lit(block)) == block - 1))
    roots = border.select(F.col("node").alias("ref"), F.col("ref").alias("root"))
    return (part.join(roots, "ref", "left")
            .select("k", "label", F.when(F.col("open"), F.col("root")).otherwise(F.col("ref")).alias("cluster_id")))
