"""Slice-by-slice tracking, run in parallel over blocks of slices.

The tracker's state after slice k depends on slice k-1 only through the live
tracks, and that memory fades within a few slices. Each block of slices is
therefore simulated from a guess of its start state, made by running the slices
just before it, and the guess is checked against the end state of the block before.

Where a border does not fit, tracking goes on from the true state until it meets the
recorded state at a later border. A check gathers such borders in runs of blocks, twice
as long each time; a run is read block by block in order, so a task holds one block,
i.e. block_slices + warmup_slices times the sensor's pixels. After the check with runs
of 2^r blocks only borders between runs can be open, so at most log2(blocks) + 1
checks lead to the result of the one-pass fold, and some more where the order of equally
near old tracks decides. Each check writes the blocks it changed and nothing else.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ptrack.functions import pixels as px
from ptrack.functions.chains import LABEL_BITS, pointer_double
from ptrack.params import Params
from ptrack.session import as_table, cut_lineage, grouped

_IN = ["k", "x", "y", "n", "n_in", "first_t", "first_idx"]
_OUT = ("blk bigint, kind string, k int, x int, y int, n bigint, n_in bigint, own bigint, entry boolean, "
        "g bigint, xm double, ym double, dstart string, dend string, sensitive boolean, used string")
_EMPTY = hashlib.md5(b"").hexdigest()


@dataclass
class Slice:
    k: int
    code: np.ndarray       # sorted raster codes of the lit pixels
    n: np.ndarray          # events per pixel
    n_in: np.ndarray       # events per pixel without the overlap
    rank: np.ndarray       # rank of each pixel's first event


class Tracker:
    """State between two slices. Subclasses set the rows of ``live``:
    own/entry name a track (birth node, or group of the start state), key orders
    tracks by birth."""

    def __init__(self, p: Params, wide: bool = False):
        self.p = p
        self.wide = wide
        self.sensitive = False     # did the order of start-state tracks decide anything?
        self.own = np.empty(0, np.int64)
        self.entry = np.empty(0, bool)
        self.key = np.empty(0, np.int64)

    def step(self, s: Slice):
        """Advance by one slice; returns (pixel positions, track positions) of the claims."""
        raise NotImplementedError

    def groups(self) -> np.ndarray:
        """Canonical number of each live track, derived from the state alone."""
        raise NotImplementedError

    def state_rows(self) -> pd.DataFrame:
        raise NotImplementedError

    def load(self, rows: pd.DataFrame) -> None:
        raise NotImplementedError

    def digest(self) -> str:
        r = self.state_rows()
        r = r[[c for c in ("x", "y", "n", "g", "xm", "ym") if c in r]]
        r = r.sort_values(list(r.columns))
        return hashlib.md5(b"".join(np.ascontiguousarray(r[c].to_numpy(np.float64)).tobytes()
                                    for c in r)).hexdigest() if len(r) else _EMPTY

    def rename_to_entry(self) -> None:
        self.own = self.groups()
        self.entry = np.ones(len(self.own), bool)

    def order(self) -> str:
        """Numbers of the start-state tracks by birth."""
        return ",".join(map(str, self.own[np.lexsort((self.own, self.key))]))


def _slices(pdf: pd.DataFrame) -> dict[int, Slice]:
    out = {}
    for k, g in pdf.groupby("k", sort=True):
        c = px.code(g.x, g.y)
        rank = np.empty(len(c), np.int64)
        rank[np.lexsort((g.first_idx, g.first_t))] = np.arange(len(c))
        o = np.argsort(c)
        out[int(k)] = Slice(int(k), c[o], g.n.to_numpy(np.int64)[o], g.n_in.to_numpy(np.int64)[o], rank[o])
    return out


_NONE = np.empty(0, np.int64)


def _simulated(blk: int, pdf: pd.DataFrame, tr: Tracker, p: Params, used: str) -> pd.DataFrame:
    """Advance by the slices of a block: its claims, its end state and its meta row."""
    k0, k1 = blk * p.block_slices, (blk + 1) * p.block_slices - 1
    slices = _slices(pdf[pdf.kind == "p"])
    tr.sensitive = False
    dstart = tr.digest()
    parts = []
    for k in range(k0, k1 + 1):
        s = slices.get(k) or Slice(k, _NONE, _NONE, _NONE, _NONE)
        at, who = tr.step(s)
        parts.append(pd.DataFrame({
            "kind": "p", "k": k, "x": s.code[at] // px.STRIDE, "y": s.code[at] % px.STRIDE, "n": s.n[at],
            "n_in": s.n_in[at], "own": tr.own[who], "entry": tr.entry[who]}))
    end = tr.state_rows().assign(kind="s", k=k1)
    meta = pd.DataFrame({"kind": ["m"], "dstart": [dstart], "dend": [tr.digest()],
                         "sensitive": [tr.sensitive], "used": [used]})
    out = pd.concat([f for f in (*parts, end, meta) if len(f)], ignore_index=True)
    out["blk"] = blk
    return out.reindex(columns=[c.split()[0] for c in _OUT.split(", ")])


def _guessed(blk: int, pdf: pd.DataFrame, tr: Tracker, p: Params) -> pd.DataFrame:
    """A block from the state that its warm-up slices leave."""
    used = ""
    if blk > 0:
        k0 = blk * p.block_slices
        slices = _slices(pdf[pdf.k < k0])
        for k in range(max(0, k0 - p.warmup_slices), k0):
            tr.step(slices.get(k) or Slice(k, _NONE, _NONE, _NONE, _NONE))
        tr.rename_to_entry()
        used = tr.order()
    return _simulated(blk, pdf, tr, p, used)


def _blocks(batches):
    """(run, block, rows) of batches that are sorted by both."""
    held: list = []
    for b in batches:
        for key, rows in b.groupby(["run", "blk"], sort=True):
            if held and held[0][0] != key:
                yield *held[0][0], pd.concat([r for _, r in held])
                held = []
            held.append((key, rows))
    if held:
        yield *held[0][0], pd.concat([r for _, r in held])


def _repaired(batches, make: Callable[[], Tracker], p: Params):
    """Blocks of a run, in order: tracking starts at an open border from the state given
    there and ends where it meets the state that the next block has started from."""
    at, tr = None, None
    for run, blk, pdf in _blocks(batches):
        if run != at:
            at, tr = run, None
        meta = pdf[pdf.kind == "m"].iloc[0]
        if tr is not None:
            tr.rename_to_entry()
            if tr.digest() == meta.dstart and (not meta.sensitive or tr.order() == meta.used):
                tr = None
        if tr is None and meta.open:
            tr = make()
            tr.load(pdf[pdf.kind == "s"])
        if tr is not None:
            yield _simulated(int(blk), pdf, tr, p, tr.order())


def _chain_nodes(state: DataFrame) -> DataFrame:
    """End states as links from a track's number at a border to its birth, or to its number
    at the border before."""
    return (state.select("blk", "g", "own", "entry").distinct()
            .select((F.shiftleft(F.col("blk") + 1, LABEL_BITS) + F.col("g")).alias("node"),
                    F.when(F.col("entry"), F.shiftleft(F.col("blk"), LABEL_BITS) + F.col("own"))
                    .otherwise(F.col("own")).alias("ref"), F.col("entry").alias("open")))


def _in_runs(rows: DataFrame) -> DataFrame:
    """Whole runs in one task, block by block. Rows joined on the run look partitioned by it
    already, so a plain repartition would be left out, and an adaptive join may then split a
    run; by a hash of the run it stays."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.xxhash64("run")).sortWithinPartitions("run", "blk", "place", "k")


def block_fold(counts: DataFrame, make: Callable[[], Tracker], p: Params, log: list | None = None) -> DataFrame:
    """counts: pixel_counts of all slices. Returns (k, x, y, n, n_in, cluster_id). `log`
    gets the number of open borders at each check."""
    b, w = p.block_slices, p.warmup_slices
    src = as_table(counts.select(*_IN))
    own = F.floor(F.col("k") / b)
    homes = F.when(F.pmod("k", F.lit(b)) >= b - w, F.array(own, own + 1)).otherwise(F.array(own))
    first = src.select(F.explode(homes).alias("blk"), F.lit("p").alias("kind"), *_IN)
    # a block that only holds warm-up rows of the block before emits its own (empty) result
    found = [as_table(grouped(first, "blk").applyInPandas(lambda key, pdf: _guessed(int(key[0]), pdf, make(), p), _OUT)
                         .withColumn("version", F.lit(0)))]
    length = 2
    while True:
        every = reduce(DataFrame.unionByName, found)
        meta = (every.where("kind = 'm'").groupBy("blk")
                .agg(F.max_by(F.struct("version", "dstart", "dend", "sensitive", "used"), "version").alias("m")).select("blk", "m.*"))
        prev = meta.select((F.col("blk") + 1).alias("blk"), F.col("dend").alias("want"))
        meta = cut_lineage(meta.join(prev, "blk", "left")
                           .withColumn("open", (F.col("blk") > 0) & (F.col("dstart") != F.coalesce("want", F.lit(_EMPTY)))))
        latest = every.join(meta.select("blk", "version"), ["blk", "version"], "left_semi")
        state = latest.where("kind = 's'")
        n_open, n_sensitive = meta.agg(F.count_if("open"), F.count_if("sensitive")).first()
        key = F.col("g")
        if n_sensitive or not n_open:
            roots = pointer_double(_chain_nodes(state))
        if n_sensitive:
            # ties were decided by the order of older tracks: compare it with that of their births
            node = F.shiftleft(F.col("blk") + 1, LABEL_BITS) + F.col("g")
            state = state.withColumn("node", node).join(roots.select("node", F.col("ref").alias("birth")), "node")
            key = F.col("birth")
            order = (state.select((F.col("blk") + 1).alias("blk"), key.alias("key"), "g").distinct().groupBy("blk")
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "g"))),
                                                   lambda s: s["g"].cast("string")), ",").alias("now")))
            meta = cut_lineage(meta.join(order, "blk", "left").withColumn(
                "open", F.col("open") | ((F.col("blk") > 0) & F.col("sensitive") & (F.col("used") != F.coalesce("now", F.lit(""))))))
            n_open = meta.where("open").count()
        if log is not None:
            log.append(n_open)
        if not n_open:
            break
        run = F.floor(F.col("blk") / length)
        runs = meta.where("open").groupBy(run.alias("run")).agg(F.min("blk").alias("from"))
        rows = (src.select(own.alias("blk"), F.lit(2).alias("place"), F.lit("p").alias("kind"), *_IN)
                .unionByName(meta.select("blk", F.lit(0).alias("place"), F.lit("m").alias("kind"), "dstart", "used", "sensitive", "open"), allowMissingColumns=True)
                .unionByName(state.select((F.col("blk") + 1).alias("blk"), F.lit(1).alias("place"), "kind", "k", "x", "y", "n", "n_in", "g", "xm", "ym", key.alias("key"))
                             .join(meta.where("open").select("blk"), "blk", "left_semi"), allowMissingColumns=True)
                .withColumn("run", run).join(runs, "run").where("blk >= from").drop("from"))
        again = _in_runs(rows).mapInPandas(lambda batches: _repaired(batches, make, p), _OUT)
        found.append(as_table(again.withColumn("version", F.lit(len(found)))))
        length *= 2
    claims = latest.where("kind = 'p'")
    node = F.shiftleft(F.col("blk"), LABEL_BITS) + F.col("own")
    return (claims.withColumn("node", F.when(F.col("entry"), node))
            .join(roots.select("node", F.col("ref").alias("root")), "node", "left")
            .select("k", "x", "y", "n", "n_in", F.coalesce("root", "own").alias("cluster_id")))
