"""Best-fit packing of documents into sequences of fixed length.

Sizes are whole numbers up to the capacity, so documents and gaps, sorted by size,
are runs of equal sizes: (size, how many). The bulk-synchronous rounds work on these
runs, at most `capacity` of each however large the corpus. A sweep sends every run of
documents to its successor, the smallest gap that holds it; where several runs meet in
one gap run, ranks decide: larger documents first. A gap takes one document in a sweep
and is then a smaller gap. Documents without a successor open sequences. What a sweep
decided is an interval of ranks, and Spark gives every piece its rank and its place."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ptrack.llm.common import parts, stored
from ptrack.llm.tokens import REMEMBERED, encoder, text_runs

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLAN = "length int, first_rank long, ranks long, first_sequence long, offset int"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of doc_id, text (null: empty): a document with its end id is one piece if it
    fits, otherwise it is cut into pieces of the capacity, the first of them shorter."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def cut(batches):
        tok = encoder(vocabulary, remembered)
        for b in batches:
            names = b.column(0).to_pylist()
            for lo, texts in text_runs(b.column(1)):
                ids, per = tok.encode(texts)
                n = per + 1
                raw = np.insert(ids, np.cumsum(per), end_id).astype("<u4")     # each document with its end
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(k == 0, 0, head[doc] + (k - 1) * capacity)
                length = np.where(k == 0, head[doc], capacity)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(raw[a:a + m]) for a, m in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": [names[lo + i] for i in doc.tolist()], "piece": k.astype(np.int32), "start": start,
                                                  "length": length.astype(np.int32), "ids_crc32": crc}, schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def best_fit(counts: dict, capacity: int) -> list:
    """Sweeps over runs. counts: how many pieces there are of each length. Returns rows
    (length, first rank, ranks, first sequence, offset): pieces of a length with these
    ranks lie in sequences numbered on from the first one, at this offset."""
    docs = {s: n for s, n in counts.items() if n and s <= capacity}
    placed = dict.fromkeys(docs, 0)
    plan: list = []
    gaps: dict = {}                  # free space -> [(first sequence, how many)]
    opened = 0

    def place(s: int, first: int, n: int, free: int) -> None:
        plan.append((s, placed[s], n, first, capacity - free))
        placed[s] += n
        docs[s] -= n
        if free - s:
            freed.setdefault(free - s, []).append((first, n))

    while any(docs.values()):
        freed: dict = {}
        # sweep: larger documents first, each run to its successors among the gaps
        free = sorted(g for g, runs in gaps.items() if runs)
        for s in sorted((s for s, n in docs.items() if n), reverse=True):
            for g in free[np.searchsorted(free, s):]:
                while docs[s] and gaps[g]:
                    first, n = gaps[g].pop()
                    take = min(n, docs[s])
                    if take < n:
                        gaps[g].append((first + take, n - take))
                    place(s, first, take, g)
                if not docs[s]:
                    break
        if not freed:
            # no document fits a gap: the largest run opens sequences, and stays first
            # in them together with what fits beside it
            s = max(s for s, n in docs.items() if n)
            n = docs[s]
            place(s, opened, n, capacity)
            opened += n
        for g, runs in freed.items():
            gaps.setdefault(g, []).extend(runs)
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a stored table with doc_id, piece, length and more) with sequence_id and
    offset. Each sequence holds at most `capacity` ids, gapless from 0. Order within a
    length goes by bucket, doc_id, piece; equal rows get places of their own."""
    spark = pieces.sparkSession
    buckets = 4 * parts(spark)
    cut = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per = stored(per, "piece-counts")
    before = per.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # at most `capacity` rows, one per length
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    plan = spark.createDataFrame(plan, PLAN)
    ranked = (cut.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
              .join(before.select("length", "bucket", "before"), ["length", "bucket"])
              .withColumn("rank", F.col("own") + F.col("before")))
    # the plan has a few rows per sweep and length, whatever the number of pieces
    placed = ranked.alias("d").join(F.broadcast(plan).alias("p"), (F.col("d.length") == F.col("p.length")) &
                                    (F.col("d.rank") >= F.col("p.first_rank")) & (F.col("d.rank") < F.col("p.first_rank") + F.col("p.ranks")))
    return placed.select("d.*", (F.col("p.first_sequence") + F.col("d.rank") - F.col("p.first_rank")).alias("sequence_id"),
                         F.col("p.offset")).drop("bucket", "own", "before", "rank")


def packed(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs. `remembered`
    bounds the memory of a worker, not the result."""
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity, remembered), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                                         "sequence_id", F.col("offset").cast("long").alias("offset"))
